"""CSV captures, uploads, metric files; prepared tables in and out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.clean import normalize_label
from ..operators.order import with_positions
from ..storage import hadoop
from .artifacts import publish, read_text

# The columns that a log upload may call a field by.
UPLOAD_ALIASES = {"src_ip": ["Src IP", "src_ip"], "dst_ip": ["Dst IP", "dst_ip"], "protocol": ["Protocol", "protocol"], "attack_type": ["Label", "attack_type"], "label": ["Label", "label"]}


def list_csv(spark: SparkSession, directory: str) -> list[str]:
    """The CSV files of a directory by name; FileNotFoundError if there are none. By Hadoop's file system, so any store works."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(x.getPath().toString() for x in fs.listStatus(path) if x.isFile() and x.getPath().getName().lower().endswith(".csv")) if fs.exists(path) else []
    if not found:
        raise FileNotFoundError(f"no CSV file in {directory}")
    return found


def read_flows(spark: SparkSession, directory: str) -> DataFrame:
    """All captures by name, header names stripped, with source_file, source_row_index (from 0 in each file) and sample_id. The row index follows the
    order in the file."""
    out = None
    for path in list_csv(spark, directory):
        raw = spark.read.option("header", True).csv(path)
        raw = raw.toDF(*[c.strip() for c in raw.columns])
        if "Label" not in raw.columns:
            raise ValueError(f"{path} has no column Label")
        name = path.rsplit("/", 1)[-1]
        # Ids rise with the place in the file; a window over the file's part offsets makes them gapless.
        raw = raw.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
        sizes = raw.groupBy("_part").agg(F.count("*").alias("_n"))
        start = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each part
        raw = raw.join(F.broadcast(sizes.select("_part", start.alias("_start"))), "_part")
        row = (F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).cast("int")
        raw = raw.withColumn("source_file", F.lit(name)).withColumn("source_row_index", row).withColumn("sample_id", F.concat_ws("#", "source_file", "source_row_index")).drop("_id", "_part", "_n", "_start")
        out = raw if out is None else out.unionByName(raw, allowMissingColumns=True)
    return out


def first_column(df: DataFrame, names: list[str]):
    """The first of the names that is a column, else null."""
    return next((F.col(f"`{n}`") for n in names if n in df.columns), F.lit(None).cast("string"))


def read_upload(spark: SparkSession, path: str, aliases: dict[str, list[str]] = UPLOAD_ALIASES) -> DataFrame:
    """An uploaded CSV as log rows: aliased fields and raw_text, the cells joined by ' | '; event_time is now."""
    raw = spark.read.option("header", True).csv(path)
    return upload_rows(raw, aliases).withColumn("event_time", F.current_timestamp())


def upload_rows(raw: DataFrame, aliases: dict[str, list[str]] = UPLOAD_ALIASES) -> DataFrame:
    text = F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in raw.columns])
    return raw.select(*[first_column(raw, names).alias(k) for k, names in aliases.items()], text.alias("raw_text"))


def preview(rows: DataFrame, order: str, n: int = 5) -> DataFrame:
    return rows.orderBy(order).limit(n)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A metrics CSV; blank and 'null' are null."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return df.select(*[F.when(F.lower(F.trim(F.col(f"`{c}`").cast("string"))).isin("", "null"), None).otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """A summary in JSON (one object, over any number of lines) as one row."""
    return spark.read.option("multiLine", True).json(path)


PREPARED = ("flows", "flows_tokens", "pairs_train", "vocab", "preprocessor")
METADATA = "metadata.json"


def write_prepared(tables: dict[str, DataFrame], directory: str, metadata: dict | None = None) -> None:
    """The tables as Parquet; metadata as JSON, last, so that it is there only beside whole tables."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{directory}/{name}")
    if metadata is not None:
        publish(next(iter(tables.values())).sparkSession, f"{directory}/{METADATA}", json.dumps(metadata, sort_keys=True, default=str))


def read_prepared(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A prepared table; FileNotFoundError if it isn't there."""
    fs, path = hadoop(spark, f"{directory}/{name}")
    if not fs.exists(path):
        raise FileNotFoundError(f"{directory}/{name}: prepare first")
    return spark.read.parquet(f"{directory}/{name}")


def read_metadata(spark: SparkSession, directory: str) -> dict:
    text = read_text(spark, f"{directory}/{METADATA}")
    if text is None:
        raise FileNotFoundError(f"{directory}/{METADATA}: prepare first")
    return json.loads(text)


def labels(spark: SparkSession, prepared: str, raw: str | None = None) -> DataFrame:
    """label, n, most frequent first: of the prepared flows, or where there are none of the raw captures."""
    try:
        df = read_prepared(spark, prepared, "flows").select(F.col("Label").alias("label"))
    except FileNotFoundError:
        if raw is None:
            raise
        df = read_flows(spark, raw).select(normalize_label(F.col("Label")).alias("label"))
    return df.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def row_at(df: DataFrame, id_col: str, row_id: str | None = None, row_index: int | None = None) -> DataFrame:
    """The row with an id, or at a place (from 0) in the order of ids. ValueError without such a row, or unless exactly one of both is given."""
    if (row_id is None) == (row_index is None):
        raise ValueError("give an id or an index")
    if row_id is not None:
        found = df.where(F.col(id_col).cast("string") == row_id)
        if not found.limit(1).count():
            raise ValueError(f"no row {row_id}")
        return found
    n = df.count()
    if not 0 <= row_index < n:
        raise ValueError(f"index {row_index} outside 0 to {n - 1}")
    at = with_positions(df.select(id_col), id_col).where(F.col("pos") == row_index).select(id_col)
    return df.join(F.broadcast(at), id_col, "left_semi")  # one row


# The columns of a query's result file and their kinds.
RESULT = "query_id string, candidate_id string, query_label string, candidate_label string, hash_bucket_hits bigint, similarity double, is_same_label int, rank int"


def write_result_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_result_csv(spark: SparkSession, path: str) -> DataFrame:
    """A result that write_result_csv wrote, with its types; a cell that doesn't fit its type fails the job."""
    return spark.read.schema(RESULT).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def export_csv(frames: dict[str, DataFrame], directory: str) -> list[str]:
    """Each frame as a folder of CSV files with headers; the folders' paths. Arrays are joined by blanks."""
    for name, df in frames.items():
        flat = [F.array_join(f"`{c}`", " ").alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", True).csv(f"{directory}/{name}")
    return [f"{directory}/{n}" for n in frames]
