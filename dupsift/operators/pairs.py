"""Labelled pair samples. Every draw is the order of an MD5, so that samples are the same on every cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..storage import kept
from .clean import md5_order
from .order import order_statistics


#: Rows of one piece, about.
PIECE_ROWS = 100_000


def _neighbours(df: DataFrame, kind: str, by: list[str], salts: int, seed: int, ahead: int = 1) -> DataFrame:
    """Rows beside the rows that follow in MD5 order within (by, salt); a salt is the MD5's first two digits modulo `salts`. Groups larger than PIECE_ROWS a salt are ordered in pieces, which
    are ranges of the MD5; what follows the last rows of a piece is found among the first and last rows of all pieces. Only ids are ordered, the other columns are joined to the pairs."""
    slim = df.select("id", *by).withColumn("_o", md5_order(f"{seed}|{kind}", "id"))
    sizes = slim.groupBy(*by).agg(F.ceil(F.count("*") / (salts * PIECE_ROWS)).alias("_pieces"))
    if by:
        slim = slim.join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, by)
    else:
        slim = slim.withColumn("_pieces", F.lit(max(1, sizes.first()[0])))
    digits = lambda at, n: F.conv(F.substring("_o", at, n), 16, 10).cast("bigint")
    # The place of the MD5 within its salt, from 0 to 1: rises with the MD5.
    share = (F.floor(digits(1, 2) / salts) + digits(3, 10) / F.lit(float(16**10))) / F.lit(float(-(-256 // salts)))
    placed = slim.withColumn("_s", digits(1, 2) % salts).withColumn("_piece", F.floor(share * F.greatest(F.lit(1), F.col("_pieces"))))
    piece = Window.partitionBy(*by, "_s", "_piece")
    nexts = lambda w: F.array(*[F.lead("id", i).over(w) for i in range(1, ahead + 1)])
    order = piece.orderBy("_o", "id")
    after = F.count("*").over(piece) - F.row_number().over(order)
    placed = placed.select("id", *by, "_s", "_o", nexts(order).alias("_n"), (after < ahead).alias("_last"), (F.row_number().over(order) <= ahead).alias("_first"))
    placed = kept(placed, "pieces")
    ends = placed.where("_first OR _last").withColumn("_n", nexts(Window.partitionBy(*by, "_s").orderBy("_o", "id")))
    pairs = placed.where("NOT _last").select("id", "_n").union(ends.where("_last").select("id", "_n"))
    pairs = pairs.select(F.col("id").alias("id_1"), F.explode("_n").alias("id_2")).where("id_2 IS NOT NULL")
    side = lambda n: df.select(*[F.col(c).alias(f"{c}_{n}") for c in df.columns]).hint("merge")  # written tables are smaller than their rows: none is left to be broadcast
    out = pairs.join(side(1), "id_1").join(side(2), "id_2")
    return out.select(*[f"{c}_1" for c in df.columns], *[f"{c}_2" for c in df.columns])


def positive(df: DataFrame, salts: int = 4, seed: int = 42) -> DataFrame:
    """Pairs of one label: columns of df (id, label, ...) with _1 and _2."""
    return _neighbours(df, "pos", ["label"], salts, seed)


def negative(df: DataFrame, salts: int = 16, seed: int = 42) -> DataFrame:
    """Pairs of different labels."""
    return _neighbours(df, "neg", [], salts, seed).where("label_1 <> label_2")


def hard_negative(df: DataFrame, low: float = 0.3, high: float = 0.5, salts: int = 16, seed: int = 42, ahead: int = 5) -> DataFrame:
    """Pairs of different labels whose tokens (without label and source) have a Jaccard similarity in [low, high], with token_jaccard."""
    own = df.withColumn("tokens", T.content_tokens(F.col("tokens")))
    drawn = _neighbours(own, "hard", [], salts, seed, ahead).where("label_1 <> label_2")
    return drawn.withColumn("token_jaccard", F.round(T.jaccard(F.col("tokens_1"), F.col("tokens_2")), 6)).where(F.col("token_jaccard").between(low, high))


def assemble(positives: DataFrame, negatives: DataFrame, similarity: Column, strategy: str = "random") -> DataFrame:
    """id_1, id_2, label_1, label_2, target_similarity (0 for negatives), negative_strategy, is_duplicate."""
    cols = ["id_1", "id_2", "label_1", "label_2"]
    a = positives.select(*cols, similarity.alias("target_similarity"), F.lit("positive").alias("negative_strategy"), F.lit(1).alias("is_duplicate"))
    b = negatives.select(*cols, F.lit(0.0).alias("target_similarity"), F.lit(strategy).alias("negative_strategy"), F.lit(0).alias("is_duplicate"))
    return a.union(b)


def stratified(scored: DataFrame, most: int, bins: int = 10, seed: int = 42) -> DataFrame:
    """At most ceil(most / bins) pairs from each similarity bin, then others up to `most`; with similarity_bin. scored: id_1, id_2, true_sim. The last of a bin's
    share is an order statistic of the pairs' MD5, so no bin is ranked."""
    quota = -(-most // bins)
    order = F.conv(F.substring(md5_order(f"{seed}|bin", "id_1", "id_2"), 1, 13), 16, 10).cast("double")
    placed = kept(scored.withColumn("similarity_bin", T.floor_bin(F.col("true_sim"), bins)).withColumn("_o", order), "placed")
    have = {r["similarity_bin"]: r["n"] for r in placed.groupBy("similarity_bin").agg(F.count("*").alias("n")).collect()}  # a row for each bin
    ends = order_statistics(placed, {b: [min(quota, n) - 1] for b, n in have.items()}, "similarity_bin", "_o")
    limit = F.get(F.lit([float(ends.get((b, min(quota, have.get(b, 0)) - 1), -1.0)) for b in range(bins)]), F.col("similarity_bin"))
    return placed.orderBy(F.when(F.col("_o") <= limit, 0).otherwise(1), "_o", "id_1", "id_2").limit(most).drop("_o")


def split(pairs: DataFrame, stratum: str, plot: float = 0.2, validation: float = 0.2, seed: int = 42) -> DataFrame:
    """pairs with part: the first share of each stratum in MD5 order is 'plot', of the rest a share 'validation', others 'train'. The share is
    taken of the MD5's own value, so no sort is needed and any number of tasks can do it."""
    u = F.conv(F.substring(md5_order(f"{seed}|split", "id_1", "id_2"), 1, 8), 16, 10).cast("double") / float(1 << 32)
    part = F.when(u < plot, "plot").when(u < plot + (1 - plot) * validation, "validation").otherwise("train")
    return pairs.withColumn("part", part)
