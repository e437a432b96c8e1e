"""Latency of single queries, from plans as they are executed."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .order import evenly_spaced


def measured(spark: SparkSession, methods: dict[str, tuple[DataFrame, Callable[[int], DataFrame]]], most: int = 50) -> DataFrame:
    """method, query_id, rows, ms: for each method its corpus (id, ...) and the plan of one query. At most `most` evenly spaced ids of the corpus are asked, one after the other; a plan's rows
    are counted by an observed metric while it runs, so nothing runs twice. Making a plan counts, as it may write tables."""
    found = []
    for method, (corpus, plan) in methods.items():
        asked = evenly_spaced(corpus.select("id"), most, "id").orderBy("pos").collect()  # `most` rows at most
        for r in asked:
            seen = Observation()
            began = time.perf_counter()
            df = plan(r["id"]).observe(seen, F.count(F.lit(1)).alias("rows"))
            df.write.format("noop").mode("overwrite").save()
            found.append((method, r["id"], int(seen.get["rows"]), (time.perf_counter() - began) * 1000))
    return spark.createDataFrame(found, "method string, query_id bigint, rows bigint, ms double")


def average(latencies: DataFrame) -> DataFrame:
    """method, queries, avg_query_latency_ms."""
    return latencies.groupBy("method").agg(F.count("*").alias("queries"), F.avg("ms").alias("avg_query_latency_ms"))
