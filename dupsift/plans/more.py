"""More registered queries: composite reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signatures as S
from ..functions import tokens as T
from ..functions import vectors as V
from ..operators import lsh, metrics, pairs, reports, scan, text_similarity
from . import bindings as B
from .catalog import _COUNTS, _FALL, _RATES, _TPAIRS, _SQL_JACCARD, _as_scores, _doc_words, _sql_top, lsh_topk, query


@query(f"WITH {B.QROWS}, r AS (SELECT q, id, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id)::INT AS place FROM qrows) SELECT * FROM r WHERE place <= 20")
def true_neighbours(spark, d):
    return scan.best(B.coded(spark, d), [None], 20).select("q", "id", "sim", "place")


_H = "least(1.0, greatest(1e-12, {p}))"
_ENT = "-(p * log2(" + _H.format(p="p") + ") + (1 - p) * log2(" + _H.format(p="1 - p") + "))"


@query(f"""WITH {B.SCORED}, ent AS (SELECT b AS bit, count(*) AS n, round(avg((code[b + 1] > 0)::INT), 6) AS p FROM emb, range(0, 64) r(b) GROUP BY b),
g AS (SELECT 'label_pair_pred_sim' AS t, CASE WHEN label_1 = label_2 THEN 'same_label' ELSE 'different_label' END AS g, g AS name, pred_sim, true_sim FROM scored
UNION ALL SELECT 'jaccard_bin_calibration', 'jaccard_bin', greatest(0, ceil(true_sim * 10) - 1)::INT::VARCHAR, pred_sim, true_sim FROM scored),
s AS (SELECT t, g, name, count(*) AS n, round(avg(pred_sim), 6) AS p, round(median(pred_sim), 6) AS m, round(avg(true_sim), 6) AS tr FROM g GROUP BY ALL),
want AS (SELECT 'label_pair_pred_sim' AS t, unnest(['same_label', 'different_label']) AS g, unnest(['same_label', 'different_label']) AS name UNION ALL SELECT 'jaccard_bin_calibration', 'jaccard_bin', i::VARCHAR FROM range(0, 10) r(i))
SELECT 'hash_bit_entropy' AS diagnostic_type, 'bit' AS "group", bit::VARCHAR AS name, n AS count, round({_ENT}, 6) AS value, NULL::DOUBLE AS mean_pred_sim, NULL::DOUBLE AS median_pred_sim, NULL::DOUBLE AS mean_true_sim FROM ent
UNION ALL SELECT t, g, name, coalesce(n, 0), p, p, m, tr FROM want LEFT JOIN s USING (t, g, name)""")
def paper_diagnostics(spark, d):
    return reports.diagnostics(B.vectors(spark, d), B.scored_pairs(spark, d), 64)


@query(f"""WITH {_TPAIRS}, s AS (SELECT id_1, id_2, list_distinct(t_1) AS a, list_distinct(t_2) AS b, list_distinct(list_transform(range(1, len(t_1)), lambda i: t_1[i] || ' ' || t_1[i + 1])) AS c, list_distinct(list_transform(range(1, len(t_2)), lambda i: t_2[i] || ' ' || t_2[i + 1])) AS e FROM tp),
w AS (SELECT id_1, id_2, round({_SQL_JACCARD.format(a='a', b='b')}, 6) AS jaccard, round({_SQL_JACCARD.format(a='c', b='e')}, 6) AS bigram_jaccard, round(len(list_intersect(a, b)) / sqrt(len(a) * len(b)), 6) AS tf_cosine, (a = b)::INT::DOUBLE AS md5 FROM s)
UNPIVOT w ON jaccard, bigram_jaccard, tf_cosine, md5 INTO NAME metric VALUE similarity""")
def multi_similarity_frame(spark, d):
    """Several similarities of the token pairs as one long frame; md5 is exact equality."""
    p = pairs.positive(B.flow_tokens(spark, d))
    a, b = F.col("tokens_1"), F.col("tokens_2")
    wide = p.select("id_1", "id_2", F.round(T.jaccard(a, b), 6).alias("jaccard"), F.round(T.jaccard(T.bigrams(a), T.bigrams(b)), 6).alias("bigram_jaccard"), F.round(T.frequency_cosine(a, b), 6).alias("tf_cosine"), (F.md5(F.array_join(a, " ")) == F.md5(F.array_join(b, " "))).cast("double").alias("md5"))
    return reports.long_frame(wide, ["id_1", "id_2"], ["jaccard", "bigram_jaccard", "tf_cosine", "md5"])


_MODELS = f"""models AS (SELECT 'hamming' AS model, *, {_RATES} FROM (SELECT {_COUNTS.format(s='pred_sim', t='0.6', y='is_duplicate')} FROM scored)
UNION ALL SELECT 'cosine' AS model, *, {_RATES} FROM (SELECT {_COUNTS.format(s='true_sim', t='0.6', y='is_duplicate')} FROM scored)
UNION ALL SELECT 'exact' AS model, *, {_RATES} FROM (SELECT {_COUNTS.format(s='(pred_sim = 1)::INT', t='1', y='is_duplicate')} FROM scored))"""


def _models(spark, d):
    s = B.scored_pairs(spark, d)
    exact = s.withColumn("equal", (F.col("pred_sim") == 1).cast("double"))
    out = None
    for model, df, col, t in (("hamming", s, "pred_sim", 0.6), ("cosine", s, "true_sim", 0.6), ("exact", exact, "equal", 1.0)):
        one = metrics.confusion(_as_scores(df, col), t).withColumn("model", F.lit(model))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {B.SCORED}, {_MODELS} SELECT * FROM models")
def baseline_metrics(spark, d):
    """Exact equality and two thresholded scores side by side."""
    return _models(spark, d)


@query(f"WITH {B.SCORED}, {_MODELS} SELECT round(max(f1) FILTER (model = 'cosine'), 6) AS best, round(max(f1) FILTER (model = 'exact'), 6) AS baseline, round((max(f1) FILTER (model = 'cosine') - max(f1) FILTER (model = 'exact')) * 100, 2) AS delta_points FROM models")
def model_delta(spark, d):
    return reports.delta(_models(spark, d), "cosine", "exact")


@query("""SELECT coalesce(nullif(trim(CASE WHEN event_id % 3 = 0 THEN ' ' ELSE event_type END), ''), CASE WHEN event_id % 2 = 0 THEN 'from_' || event_type END, 'UNKNOWN') AS label, count(*) AS n FROM events GROUP BY 1""")
def result_labels(spark, d):
    e, i = B.table(spark, d, "events"), F.col("event_id")
    label = reports.label_of(F.when(i % 3 == 0, " ").otherwise(F.col("event_type")), F.when(i % 2 == 0, F.concat(F.lit("from_"), "event_type")), F.lit(None).cast("string"))
    return e.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, 'absent' AS other FROM events")
def json_params(spark, d):
    return B.table(spark, d, "events").select("event_id", reports.json_param(F.col("props"), "k", "none").alias("k"), reports.json_param(F.col("props"), "other", "absent").alias("other"))


@query(f"WITH t AS ({_sql_top(True, 10, _FALL.format(same='AND a.label = b.label'))}) SELECT query_id, candidate_id, round(greatest(0.72, 0.96 - 0.03 * (rank - 1))::DOUBLE, 6) AS shown, greatest(1, 5 - (rank - 1))::INT AS hits FROM t")
def fallback_demo(spark, d):
    r = F.col("rank") - 1
    return lsh_topk(spark, d).select("query_id", "candidate_id", F.round(reports.fallback_similarity(r), 6).alias("shown"), reports.fallback_hits(r).cast("int").alias("hits"))


_CONFIGS = [(16, 4), (32, 2), (64, 1)]


@query(
    f"WITH {B.SCORED}, x AS ("
    + " UNION ALL ".join(f"SELECT '{m}:{b}' AS config, true_sim, {B.BLOCK_EQ.format(n=m, w=b)} / {m}.0::DOUBLE AS pred_sim FROM scored" for m, b in _CONFIGS)
    + """), k AS (SELECT *, rank() OVER (PARTITION BY config ORDER BY true_sim) + (count(*) OVER (PARTITION BY config, true_sim) - 1) / 2 AS true_rank,
  rank() OVER (PARTITION BY config ORDER BY pred_sim) + (count(*) OVER (PARTITION BY config, pred_sim) - 1) / 2 AS pred_rank FROM x),
s AS (SELECT config, coalesce(corr(true_sim, pred_sim), 0) AS r, coalesce(corr(true_rank, pred_rank), 0) AS k, avg(abs(pred_sim - true_sim)) AS m, coalesce(abs(avg(pred_sim) FILTER (true_sim >= 0.8) - avg(true_sim) FILTER (true_sim >= 0.8)), 1.0) AS g FROM k GROUP BY config),
o AS (SELECT config, round(r, 6) AS pearson, round(k, 6) AS spearman, round(m, 6) AS mae, round(g, 6) AS gap, round(r + k - m - g, 6) AS score FROM s) SELECT *, row_number() OVER (ORDER BY score DESC, mae, config)::INT AS place FROM o"""
)
def hash_config_search(spark, d):
    s = B.scored_pairs(spark, d)
    a, b = F.col("code_1"), F.col("code_2")
    grid = F.array(*[F.struct(F.lit(f"{m}:{w}").alias("config"), V.group_collision(a, b, m, w).alias("pred_sim")) for m, w in _CONFIGS])
    return reports.selection(s.select("true_sim", F.explode(grid).alias("g")).select("true_sim", "g.*"))


@query(f"WITH {B.EMB} SELECT round(avg(m * m), 6) AS balance_loss FROM (SELECT i, avg(v[i + 1]) AS m FROM emb, range(0, 64) r(i) GROUP BY i)")
def balance_loss(spark, d):
    return reports.balance_loss(B.vectors(spark, d), "v", 64)


@query(f"WITH {B.EMB} SELECT id, round(list_dot_product(v, v), 6) AS energy, round(list_sum(list_transform(v, lambda x: abs(x))), 6) AS abs_sum, round(list_sum(v) / sqrt(list_dot_product(v, v) * 64), 6) + 0.0 AS cosine_to_ones FROM emb")
def energy_diagnostics(spark, d):
    e = reports.energies(F.col("v"))
    return B.vectors(spark, d).select("id", F.round(e["energy"], 6).alias("energy"), F.round(e["abs_sum"], 6).alias("abs_sum"), (F.round(e["cosine_to_ones"], 6) + 0.0).alias("cosine_to_ones"))


@query(f"WITH {B.SCORED} SELECT round(corr(true_sim, pred_sim), 6) AS pearson, round(median(pred_sim) FILTER (is_duplicate = 1), 6) AS duplicate_median, round(median(pred_sim) FILTER (is_duplicate = 0), 6) AS other_median FROM scored")
def result_summary(spark, d):
    p, dup = F.col("pred_sim"), F.col("is_duplicate") == 1
    r = F.coalesce(F.try_divide(F.covar_pop("true_sim", "pred_sim"), F.stddev_pop("true_sim") * F.stddev_pop("pred_sim")), F.lit(0.0))
    return B.scored_pairs(spark, d).agg(F.round(r, 6).alias("pearson"), F.round(F.median(F.when(dup, p)), 6).alias("duplicate_median"), F.round(F.median(F.when(~dup, p)), 6).alias("other_median"))


_COMBO = ", ".join(f"({a}, {b})" for a in range(4) for b in range(a + 1, 4))
_TRUE32 = "(least(1.0, greatest(0.0, 1 - pow(1 - pow(sim, 32), 6))) >= 0.5)"


@query(f"""WITH {B.EMB}, rows_ AS (SELECT a.id AS q, b.id AS id, round({B.sql_cos('a.v', 'b.v')}, 6) AS sim, (SELECT count(*) FROM (VALUES {_COMBO}) c(x, y) WHERE a.code[x * 16 + 1 : x * 16 + 16] = b.code[x * 16 + 1 : x * 16 + 16] AND a.code[y * 16 + 1 : y * 16 + 16] = b.code[y * 16 + 1 : y * 16 + 16]) > 0 AS c FROM emb a JOIN emb b ON a.id % 50 = 0 AND a.id <> b.id),
g AS (SELECT q, count(*) FILTER (c) AS n, count(*) FILTER (c AND {_TRUE32}) AS h, count(*) FILTER ({_TRUE32}) AS t FROM rows_ GROUP BY q), pr AS (SELECT q, n, h / nullif(n, 0)::DOUBLE AS p, h / nullif(t, 0)::DOUBLE AS r FROM g)
SELECT q, n AS n_candidates, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p IS NULL OR r IS NULL THEN NULL WHEN p = 0 OR r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS fscore FROM pr""")
def simhash_precision_recall(spark, d):
    """Precision and recall of slot-combination candidates: K is 2 slots of 16 bits, L the 6 choices."""
    return metrics.rates(scan.precision_counts(B.coded(spark, d), [(16, 2, 32, 6)]))


@query()
def method_scores(spark, d):
    """Stated queries (ids divisible by 50) against all documents: exact equality and SimHash similarity."""
    docs = _doc_words(spark, d).select("id", S.simhash_md5("tokens").alias("word"), F.md5(F.array_join("tokens", " ")).alias("m"))
    q = docs.where("id % 50 = 0").select(F.col("id").alias("q"), F.col("word").alias("q_word"), F.col("m").alias("q_m"))
    rows = lsh.in_blocks(q, docs)
    return rows.select("q", "id", (F.col("q_m") == F.col("m")).cast("double").alias("exact"), F.round(S.similarity_of_bits(F.col("q_word"), F.col("word")), 6).alias("simhash"))


@query(f"""WITH {_TPAIRS} SELECT (SELECT count(*) FROM tp) AS pairs, (SELECT count(DISTINCT array_to_string(tokens, ' ')) FROM tokens) AS kinds, (SELECT count(*) FROM tokens) AS rows""")
def token_classes(spark, d):
    t = B.flow_tokens(spark, d)
    c = text_similarity.compression_rate(t.select(F.array_join("tokens", " ").alias("s")), "s")
    n = pairs.positive(t).agg(F.count("*").alias("pairs"))
    return n.crossJoin(c.select("kinds", "rows"))  # one row each
