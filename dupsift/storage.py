"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or with a local master the warehouse's folder. Elsewhere an unset one is an error, since a folder of one machine would lose data."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/dupsift-tables"


def hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def kept(df: DataFrame, label: str) -> DataFrame:
    """df written to a new table and read back: computed once, lineage cut, safe from lost executors. The files go when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/dupsift-{uuid.uuid4().hex}"
    fs, p = hadoop(spark, path)
    fs.deleteOnExit(p)
    df.write.option("compression", "zstd").parquet(f"{path}/{label}")
    return spark.read.schema(df.schema).parquet(f"{path}/{label}")
