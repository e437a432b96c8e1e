"""Exact nearest neighbours of 64-bit signatures in Hamming space.

Every stated signature is held against all distinct ones, in blocks of packed integers, and only the nearest of each block leave it (`scan.nearest_words`). Signatures of texts are crowded, so that
tables of their parts would give most of all pairs anyway, a row each. Equal signatures are one: of each no more than the k + 1 rows that could be
answers are kept, so a signature shared by many rows makes no large bucket. A few signatures (FEW) are held against all rows in one pass instead, of which only the nearest
of each partition are exchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import kept
from .scan import nearest_words

BITS = 64
FEW = 16


def nearest(signatures: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """q, id, similarity (share of equal bits), rank: the k rows nearest to each query, itself left out, ties to the larger id. signatures: id, word;
    queries: q, word (q an id of signatures or not)."""
    if queries.limit(FEW + 1).count() <= FEW:
        asked = F.broadcast(queries.select("q", F.col("word").alias("asked")))
        near = signatures.select("id", "word").join(asked, ~F.col("q").eqNullSafe(F.col("id")))
        return _ranked(near.withColumn("distance", F.bit_count(F.col("asked").bitwiseXOR(F.col("word")))).where("distance IS NOT NULL"), k)
    best = Window.partitionBy("word").orderBy(F.desc("id"))
    rows = kept(signatures.select("id", "word").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("id", "word"), "rows")
    words = kept(rows.groupBy("word").agg(F.count("*").alias("members")), "words")
    asked = kept(queries.where("word IS NOT NULL").select(F.col("word").alias("id"), "word").distinct(), "asked")
    # The k + 1 nearest distinct signatures and all that tie with the last: their rows may have larger ids. Fewer than k other rows can't be among them.
    found = nearest_words(asked, words.where("word IS NOT NULL").select(F.col("word").alias("id"), "word"), k + 1)
    return _ranked(queries.select("q", F.col("word").alias("asked")).join(found, "asked").join(rows, "word").where(~F.col("q").eqNullSafe(F.col("id"))), k)


def _ranked(answers: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy("distance", F.desc("id"))
    ranked = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("q", "id", F.round(1 - F.col("distance") / F.lit(float(BITS)), 6).alias("similarity"), "rank")
