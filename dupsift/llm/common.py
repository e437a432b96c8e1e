"""What the operators of this subpackage share: the shared folder, written tables, checks of arguments."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that go to Python at once while a table is written: texts may be long, and both sides hold a batch.
BATCH_ROWS, _BATCH = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"

#: In a Python worker: what empties that which an operator keeps there from task to task, by the operator's name.
KEPT: dict[str, Callable[[], None]] = {}
#: Bytes of input after which a worker gives freed memory back.
_TRIM = 4 << 20


def _trim() -> None:
    """Give freed memory back to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def spare(batches: Iterator[pa.RecordBatch], owner: str = "") -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most BATCH_ROWS rows. Spark's Python workers live on from stage to stage, so what other operators' tasks have kept in this one goes first,
    and memory that is freed goes back to the system, lest it count besides that of all later stages."""
    for name in [k for k in KEPT if k != owner]:
        KEPT.pop(name)()
    _trim()
    held = 0
    for b in batches:
        for at in range(0, b.num_rows, BATCH_ROWS):
            part = b.slice(at, BATCH_ROWS)
            yield part
            held += part.nbytes
            if held > _TRIM:
                _trim()
                held = 0
    _trim()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine (a local master) the warehouse's. Elsewhere an unset one is an error,
    since a folder of one machine would lose data."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/dupsift-checkpoints"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/dupsift-{uuid.uuid4().hex}/{label}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(os.path.dirname(path))
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def materialize(df: DataFrame, label: str, batch: int = BATCH_ROWS) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut and survives lost executors. batch: rows that go to Python at once."""
    path, conf = fresh_path(df.sparkSession, label), df.sparkSession.conf
    rows = int(conf.get(_BATCH))
    conf.set(_BATCH, str(min(rows, batch) if rows > 0 else batch))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_BATCH, str(rows))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a materialised table that is no longer read."""
    jvm = spark.sparkContext._jvm
    for parent in {os.path.dirname(f) for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(parent)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Mark df for broadcast only when its counted rows are within limit; otherwise the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def partitions_for(spark: SparkSession, total_bytes: int, each: int = 32 << 20) -> int:
    """How many partitions hold total_bytes at `each` bytes, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total_bytes) // each))


def without(docs: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """docs without the rows whose id and text hash are in found (doc_id, h; a written table). found is broadcast up to limit counted rows; beyond that
    the join shuffles. Columns of docs may have any names."""
    right = broadcast_if_small(found, found.count(), limit)
    return docs.join(right, (F.xxhash64(docs["text"]) == right["h"]) & docs["doc_id"].eqNullSafe(right["doc_id"]), "left_anti")


def fresh_name(df: DataFrame) -> str:
    """A name that no column of df has."""
    return "_" + "_".join(df.columns)
