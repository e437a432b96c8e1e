"""The relations that the registered queries run on, built from whole driver tables; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import clean, lsh, pairs
from ..storage import kept

FEATURES = ["n_lines", "qty", "max_price", "total", "one"]
BANDS, WIDTH, BLOCKS = 8, 8, 16


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def flows(spark: SparkSession, d: str) -> DataFrame:
    """An order with its lines as a flow; raw_total is text with missing and junk values put in. Written once, as quantiles and places read it several times."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("double").alias("n_lines"), F.sum("l_quantity").alias("qty"), F.max("l_extendedprice").alias("max_price"))
    key = F.col("o_orderkey")
    raw = F.when(key % 17 == 0, None).when(key % 19 == 0, "NaN").when(key % 23 == 0, "junk").otherwise(F.col("o_totalprice").cast("string"))
    made = (
        table(spark, d, "orders")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .select(key.alias("id"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("source"), "n_lines", "qty", "max_price", clean.to_number(raw).alias("total"), F.lit(1.0).alias("one"))
    )
    return kept(made, "flows")


FLOWS = """flows AS (SELECT o_orderkey AS id, o_orderpriority AS label, o_orderstatus AS source, n_lines, qty, max_price,
  CASE WHEN o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 OR o_orderkey % 23 = 0 THEN NULL ELSE o_totalprice END AS total, 1.0::DOUBLE AS one
  FROM orders JOIN (SELECT l_orderkey, count(*)::DOUBLE AS n_lines, sum(l_quantity) AS qty, max(l_extendedprice) AS max_price FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def flow_tokens(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """id, label, tokens. Missing values count as 0 here. rows: the flows, if they are there."""
    f = (flows(spark, d) if rows is None else rows).na.fill(0.0, FEATURES)
    features = clean.sequence_features(FEATURES)
    edges = clean.bin_edges(f, features)
    return f.select("id", "label", clean.bin_tokens(F.col("label"), F.col("source"), edges).alias("tokens"))


def _sql_bin(f: str) -> str:
    x = f"coalesce({f}, 0.0)"
    return f"""'{f}=bin_' || (CASE WHEN {x} <= e_{f}[1] THEN 0 WHEN {x} >= e_{f}[-1] THEN len(e_{f}) - 2 ELSE len(list_filter(e_{f}[2:-2], lambda e: {x} >= e)) END)::VARCHAR"""


EDGES = "edges AS (SELECT " + ", ".join(
    f"""(CASE WHEN len(q_{f}) = 1 THEN [q_{f}[1], q_{f}[1] + 1] ELSE q_{f} END) AS e_{f}""" for f in FEATURES
) + " FROM (SELECT " + ", ".join(f"list_sort(list_distinct(quantile_cont(coalesce({f}, 0.0), [0.0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0]))) AS q_{f}" for f in FEATURES) + " FROM flows))"
TOKENS = f"{FLOWS}, {EDGES}, tokens AS (SELECT id, label, ['label=' || label, 'source=' || source, {', '.join(map(_sql_bin, FEATURES))}] AS tokens FROM flows, edges)"


def coded(spark: SparkSession, d: str) -> DataFrame:
    return lsh.codes(table(spark, d, "embeddings"), "vec_id", "embedding", "label")


EMB = """emb AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE -1 END) AS code FROM embeddings)"""
BAND = f"""bands AS (SELECT id, label, b AS band, array_to_string(code[b * {WIDTH} + 1 : b * {WIDTH} + {WIDTH}], '') AS key FROM emb, range(0, {BANDS}) r(b))"""
COS = "(CASE WHEN list_dot_product({a}, {a}) * list_dot_product({b}, {b}) = 0 THEN 0.5 ELSE (greatest(-1.0, least(1.0, list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))) + 1) / 2 END)"


def sql_cos(a: str, b: str) -> str:
    return COS.format(a=a, b=b)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """id, label, v, code."""
    t = table(spark, d, "embeddings")
    return t.select(F.col("vec_id").alias("id"), "label", V.doubles(F.col("embedding")).alias("v"), V.sign_code(F.col("embedding")).alias("code"))


def vector_pairs(spark: SparkSession, d: str) -> DataFrame:
    """id_1, id_2, label_1, label_2, v_1, v_2, code_1, code_2, is_duplicate: positives and random negatives."""
    v = vectors(spark, d)
    return pairs.positive(v).withColumn("is_duplicate", F.lit(1)).union(pairs.negative(v).withColumn("is_duplicate", F.lit(0)))


def sql_neighbours(kind: str, by: str, salts: int, source: str, ahead: int = 1) -> str:
    o = f"md5('42|{kind}|' || id::VARCHAR)"
    part = f"PARTITION BY {by}{', ' if by else ''}s ORDER BY o, id"
    return f"""SELECT a.id AS id_1, b.id AS id_2, a.label AS label_1, b.label AS label_2 FROM (
  SELECT id, label, lead(id, {ahead}) OVER ({part}) AS nxt FROM (SELECT id, label, {o} AS o, ('0x' || substring({o}, 1, 2))::INT % {salts} AS s FROM {source})) a JOIN {source} b ON a.nxt = b.id"""


PAIRS = f"""{EMB}, pairs AS (SELECT *, 1 AS is_duplicate FROM ({sql_neighbours('pos', 'label', 4, 'emb')})
  UNION ALL SELECT *, 0 AS is_duplicate FROM ({sql_neighbours('neg', '', 16, 'emb')}) WHERE label_1 <> label_2),
vp AS (SELECT p.*, a.v AS v_1, b.v AS v_2, a.code AS code_1, b.code AS code_2 FROM pairs p JOIN emb a ON a.id = id_1 JOIN emb b ON b.id = id_2)"""
HAM = "(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN code_1[i] = code_2[i] THEN 1.0 ELSE 0.0 END)) / 64)"
BLOCK_EQ = "len(list_filter(range(0, {n}), lambda i: code_1[i * {w} + 1 : i * {w} + {w}] = code_2[i * {w} + 1 : i * {w} + {w}]))"
SCORED = f"{PAIRS}, scored AS (SELECT *, round({sql_cos('v_1', 'v_2')}, 6) AS true_sim, round({HAM}, 6) AS pred_sim FROM vp)"


def scored_pairs(spark: SparkSession, d: str) -> DataFrame:
    """vector_pairs with true_sim (cosine01) and pred_sim (share of equal sign bits)."""
    p = vector_pairs(spark, d)
    return p.withColumn("true_sim", F.round(V.cosine01(F.col("v_1"), F.col("v_2")), 6)).withColumn("pred_sim", F.round(V.hamming_similarity(F.col("code_1"), F.col("code_2")), 6))


def query_rows(spark: SparkSession, d: str) -> DataFrame:
    """q, id, sim and candidate flags of the stated queries (ids divisible by 50) against all other rows. candidate: a bucket of 8 x 8 bits
    is shared; c1, c2, c3: of 4 x 16, 8 x 8, 16 x 4 bits."""
    c = coded(spark, d)
    q = c.where("id % 50 = 0").select(F.col("id").alias("q"), F.col("v").alias("q_v"), F.col("word").alias("q_word"))
    rows = lsh.in_blocks(q, c.select("id", "v", "word")).withColumn("sim", F.round(V.cosine01(F.col("q_v"), F.col("v")), 6))
    for n, (bands, width) in enumerate([(4, 16), (8, 8), (16, 4)], 1):
        rows = rows.withColumn(f"c{n}", F.arrays_overlap(*[F.transform(V.band_keys(F.col(w), bands, width), lambda x, i: x * 64 + i) for w in ("q_word", "word")]).cast("int"))
    return rows.select("q", "id", "sim", "c1", "c2", "c3").withColumn("candidate", F.col("c2"))


QROWS = f"{EMB}, qrows AS (SELECT *, c2 AS candidate FROM (SELECT a.id AS q, b.id AS id, round({sql_cos('a.v', 'b.v')}, 6) AS sim, " + ", ".join(
    f"(len(list_filter(range(0, {n}), lambda i: a.code[i * {w} + 1 : i * {w} + {w}] = b.code[i * {w} + 1 : i * {w} + {w}])) > 0)::INT AS c{k}" for k, (n, w) in enumerate([(4, 16), (8, 8), (16, 4)], 1)
) + " FROM emb a JOIN emb b ON a.id % 50 = 0 AND a.id <> b.id))"
