"""Task and result bookkeeping, dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def redundant(similarity: Column, threshold: float) -> Column:
    return F.when(similarity >= threshold, 1).otherwise(0)


def task_results(results: DataFrame, threshold: float) -> DataFrame:
    """Retrieval rows as result rows: log_id (rank), score (4 digits, halves up) and is_redundant by the unrounded similarity."""
    return results.withColumn("is_redundant", redundant(F.col("similarity"), threshold)).withColumn("similarity_score", F.round("similarity", 4)).withColumnRenamed("rank", "log_id")


def task_stats(results: DataFrame, by: str) -> DataFrame:
    """total_logs, redundant_logs, compression_rate (percent, 2 digits) for each `by`."""
    g = results.groupBy(by).agg(F.count("*").alias("total_logs"), F.sum("is_redundant").alias("redundant_logs"))
    return g.withColumn("compression_rate", F.round(F.coalesce(F.try_divide(F.col("redundant_logs") * 100.0, F.col("total_logs").cast("double")), F.lit(0.0)), 2))


def overview(tasks: DataFrame) -> DataFrame:
    """Of tasks (status, total_logs, compression_rate, latency): counts, sums and means that leave nulls out (0 if none, 2 digits)."""
    return tasks.agg(
        F.count("*").alias("tasks"),
        F.sum(F.coalesce("total_logs", F.lit(0))).alias("logs"),
        F.count_if(F.col("status") != "FAILED").alias("not_failed"),
        F.round(F.coalesce(F.avg("compression_rate"), F.lit(0.0)), 2).alias("mean_compression"),
        F.round(F.coalesce(F.avg("latency"), F.lit(0.0)), 2).alias("mean_latency"),
    )


def type_counts(logs: DataFrame, kind: str, id_col: str) -> DataFrame:
    """kind, n, place: counts in order of first appearance."""
    g = logs.groupBy(kind).agg(F.count("*").alias("n"), F.min(id_col).alias("_first"))
    return g.withColumn("place", F.row_number().over(Window.orderBy("_first"))).drop("_first")  # over kinds only


def recent(df: DataFrame, time: str, id_col: str, n: int = 5) -> DataFrame:
    return df.orderBy(F.desc(time), F.desc(id_col)).limit(n)


def model_type(x: Column) -> Column:
    """Blank or null is bigru; else trimmed lower case."""
    return F.coalesce(F.nullif(F.lower(F.trim(x)), F.lit("")), F.lit("bigru"))


def keep_per_window(logs: DataFrame, keys: list[str], time: str, seconds: int, policy: str = "EARLIEST", id_col: str = "event_id") -> DataFrame:
    """One row for each key and time bucket: the EARLIEST or LATEST, ties to the smaller id. A batch extension of the stored, unused task
    fields; min_by keeps one row a group in each map task, so hot keys don't travel."""
    bucket = F.floor(F.unix_timestamp(F.col(time).cast("timestamp")) / seconds)
    t = F.unix_micros(F.col(time).cast("timestamp"))
    order = F.struct(t if policy == "EARLIEST" else -t, F.col(id_col))
    row = F.min_by(F.struct(*logs.columns), order)
    return logs.withColumn("_b", bucket).groupBy(*keys, "_b").agg(row.alias("_r")).select("_r.*")


def displayed(models: DataFrame, names: dict[str, str], core: list[str] | None = None) -> DataFrame:
    """Rows of the core models (all unless given) with display_name (the model's own where it has none) and place, the names' order; models without a name come last, by name."""
    own = models.where(F.col("model").isin(core)) if core is not None else models
    named = own.withColumn("display_name", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), "model"), "model"))
    at = F.array_position(F.lit(list(names)), F.col("model"))
    order = Window.orderBy(F.when(at == 0, len(names) + 1).otherwise(at), "model")  # over models only
    return named.withColumn("place", F.row_number().over(order))


def validated(task: dict) -> dict:
    """A task request with its defaults: task_name, model_type and reserve_policy not blank, similarity_threshold in [0.10, 1.00], time_window and hash_bits whole numbers, label_scope
    same or all, top_k at least 1. ValueError names all that is wrong."""
    out = {"label_scope": "same", "top_k": 10, "row_index": None, "sample_id": None} | {k: v for k, v in task.items() if v is not None}
    wrong = [k for k in ("task_name", "model_type", "reserve_policy") if not str(out.get(k) or "").strip()]
    t = out.get("similarity_threshold")
    if not isinstance(t, int | float) or isinstance(t, bool) or not 0.1 <= t <= 1.0:
        wrong.append("similarity_threshold")
    wrong += [k for k in ("time_window", "hash_bits") if not isinstance(out.get(k), int) or isinstance(out.get(k), bool)]
    if out["label_scope"] not in ("same", "all"):
        wrong.append("label_scope")
    if not isinstance(out["top_k"], int) or out["top_k"] < 1:
        wrong.append("top_k")
    if wrong:
        raise ValueError("not valid: " + ", ".join(wrong))
    return out | {"model_type": out["model_type"].strip().lower()}


def new_task(spark: SparkSession, request: dict) -> DataFrame:
    """The row of a valid request: PENDING, nothing counted yet."""
    r = validated(request)
    row = [(r["task_name"], float(r["similarity_threshold"]), r["time_window"], r["reserve_policy"], r["hash_bits"], r["model_type"], r["sample_id"], r["row_index"], r["label_scope"], r["top_k"])]
    df = spark.createDataFrame(row, "task_name string, similarity_threshold double, time_window int, reserve_policy string, hash_bits int, model_type string, sample_id string, row_index int, label_scope string, top_k int")
    zero = {"total_logs": "bigint", "redundant_logs": "bigint", "compression_rate": "decimal(5,2)", "avg_latency_ms": "decimal(8,2)"}
    df = df.withColumn("similarity_threshold", F.col("similarity_threshold").cast("decimal(4,2)"))
    return df.withColumns({"status": F.lit("PENDING"), "create_time": F.current_timestamp()} | {c: F.lit(0).cast(t) for c, t in zero.items()})
