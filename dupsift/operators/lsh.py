"""Banded LSH over packed sign codes: buckets, candidate pairs, top-k retrieval with fallback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import scan


def shape_for(rows: int, bucket: int = 64, bits: int = 64, least: int = 8) -> tuple[int, int]:
    """(bands, width) of which a random row shares a bucket with about `bucket` others at most: the least power of two of bits, from `least` to 32, that gives so many keys. Pairs
    within buckets then grow with rows * bucket, not with the square of the rows."""
    width = least
    while width < min(32, bits) and rows > bucket << width:
        width *= 2
    return bits // width, width


def codes(df: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """id, label, v (as it is; what compares vectors makes doubles of them), word (the packed sign code)."""
    return df.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"), V.packed(V.sign_code(F.col(vector))).alias("word"))


def classes(coded: DataFrame) -> DataFrame:
    """Equal codes as one: id (the least), word, n."""
    return coded.groupBy("word").agg(F.min("id").alias("id"), F.count("*").alias("n"))


def band_table(coded: DataFrame, bands: int, width: int, *keep: str) -> DataFrame:
    """A row for each id and band: id, band, key."""
    return coded.select("id", *keep, F.posexplode(V.band_keys(F.col("word"), bands, width)).alias("band", "key"))


def buckets(coded: DataFrame, bands: int, width: int) -> DataFrame:
    """Membership of the buckets with more than one member: band, key, id, n. Sizes are counted map-side first; no bucket is gathered."""
    table = band_table(coded, bands, width)
    sizes = table.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    return table.join(sizes, ["band", "key"])


def candidates(coded: DataFrame, bands: int, width: int, split_above: int | None = None) -> DataFrame:
    """Pairs a < b of classes of equal codes that share a bucket, with the number of bands: copies aren't expanded into pairs. split_above: buckets of more classes are cut by the bits of the next
    band, so that a hot bucket makes no square of pairs; of such a bucket only pairs that agree in both bands count."""
    rows = classes(coded)
    if split_above is None and width in scan.LANES:
        return scan.sharing(rows, bands, width)
    table = band_table(rows, bands, width, "word")
    on = ["band", "key"]
    if split_above is not None:
        large = table.groupBy("band", "key").agg(F.count("*").alias("members")).where(F.col("members") > split_above).select("band", "key", F.lit(True).alias("large"))
        following = F.get(V.band_keys(F.col("word"), bands, width), (F.col("band") + 1) % bands)
        table = table.join(large, on, "left").withColumn("more", F.when(F.col("large"), following).otherwise(F.lit(-1).cast("bigint")))
        on = [*on, "more"]
    table = table.select("id", *on)
    a, b = table.alias("a"), table.alias("b")
    same = F.lit(True)
    for c in on:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, same & (F.col("a.id") < F.col("b.id"))).groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b")).agg(F.count("*").alias("hits"))


def combo_candidates(coded: DataFrame, slots: int, chosen: int) -> DataFrame:
    """Pairs a < b of classes whose codes agree in some choice of slots."""
    table = classes(coded).select("id", F.explode(V.slot_keys(F.col("word"), slots, chosen)).alias("k")).select("id", "k.combo", "k.key")
    a, b = table.alias("a"), table.alias("b")
    return a.join(b, (F.col("a.combo") == F.col("b.combo")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def hits(coded: DataFrame, queries: DataFrame, bands: int, width: int, same_label: bool) -> DataFrame:
    """q, id, hits: rows other than the query that share a bucket with it, of its label only where asked."""
    left = band_table(queries, bands, width, "label").select(F.col("id").alias("q"), F.col("label").alias("q_label"), "band", "key")
    joined = left.join(band_table(coded, bands, width, "label"), ["band", "key"]).where("q <> id")
    if same_label:
        joined = joined.where("q_label = label")
    return joined.groupBy("q", "id").agg(F.count("*").alias("hits"))


#: Rows of a block that a stated query set is held against.
BLOCK_ROWS = 50_000


def in_blocks(queries: DataFrame, corpus: DataFrame, blocks: int | None = None, anyone: bool = False) -> DataFrame:
    """A stated query set against all rows: queries (q, ...) go to every block of the corpus (id, ...); an equi-join on the block. There are as many blocks as
    BLOCK_ROWS rows each need, at least the session's shuffle partitions, unless their number is given. anyone: also where q = id."""
    if blocks is None:
        blocks = max(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-corpus.count() // BLOCK_ROWS))
    joined = (
        # A block's queries are a hash table; a merge would hold, and spill, the block's rows for each of them.
        queries.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).hint("shuffle_hash")
        .join(corpus.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), "_block")
        .drop("_block")
    )
    return joined if anyone else joined.where("q <> id")


def top_k(coded: DataFrame, queries: DataFrame, k: int, bands: int, width: int, same_label: bool = True, fallback: bool = True, vectors: Callable | None = None, crowded: bool = False) -> DataFrame:
    """query_id, candidate_id, query_label, candidate_label, hash_bucket_hits, similarity, is_same_label, rank: by hits, similarity (6 digits), id. A
    query without candidates is held against all other rows (of its label where asked) with 0 hits. vectors, crowded: as `scan.best_by_hits` has them."""
    if width in scan.LANES and not any(df.groupBy("id").count().where("count > 1").limit(1).count() for df in (coded, queries)):
        ranked = scan.best_by_hits(coded, queries, k, bands, width, "label" if same_label else None, fallback, vectors, crowded)
        labels = lambda df, c, name: df.select(F.col("id").alias(c), F.col("label").alias(name))
        scored = ranked.join(labels(queries, "q", "query_label"), "q").join(labels(coded, "id", "candidate_label"), "id")
        return _ranked(scored)
    # Rows of one id are paired one by one.
    if vectors is not None:
        coded, queries = scan.made(coded, vectors), scan.made(queries, vectors)
    found = hits(coded, queries, bands, width, same_label)
    q = queries.select(F.col("id").alias("q"), F.col("label").alias("query_label"), F.col("v").alias("q_v"))
    if fallback:
        none = q.join(found.select("q").distinct(), "q", "left_anti")
        # Every query meets every block; a label is no unit of work, as a few may hold all rows.
        scanned = in_blocks(none.select("q", "query_label"), coded.select("id", "label"))
        if same_label:
            scanned = scanned.where(F.col("query_label") == F.col("label"))
        found = found.union(scanned.select("q", "id", F.lit(0).cast("bigint")))
    c = coded.select("id", F.col("label").alias("candidate_label"), "v")
    scored = found.join(q, "q").join(c, "id").withColumn("similarity", F.round(V.cosine01(F.col("q_v"), F.col("v")), 6))
    order = Window.partitionBy("q").orderBy(F.desc("hits"), F.desc("similarity"), "id")
    return _ranked(scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def _ranked(scored: DataFrame) -> DataFrame:
    return scored.select(
        F.col("q").alias("query_id"),
        F.col("id").alias("candidate_id"),
        "query_label",
        "candidate_label",
        F.col("hits").alias("hash_bucket_hits"),
        "similarity",
        (F.col("query_label") == F.col("candidate_label")).cast("int").alias("is_same_label"),
        "rank",
    )


def without_candidates(coded: DataFrame, queries: DataFrame, bands: int, width: int, same_label: bool = True) -> DataFrame:
    return queries.select("id", "label").join(hits(coded, queries, bands, width, same_label).select(F.col("q").alias("id")).distinct(), "id", "left_anti")
