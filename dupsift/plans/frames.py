"""Registered queries: frames of several measures and predictors, stacks of methods, held-out parts, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signatures as S
from ..functions import tokens as T
from ..functions import vectors as V
from ..operators import draws, metrics, pairs, text_similarity
from ..storage import kept
from . import bindings as B
from .catalog import _COUNTS, _RATES, _SIMHASH, SQL, query
from .more import _MODELS, _models
from .retrieval import _MSCORES, _methods


def _sql_best(rows: str, thresholds: list[float]) -> str:
    levels = ", ".join(f"({t}::DOUBLE)" for t in thresholds)
    return f"""th(threshold) AS (VALUES {levels}), cells AS (SELECT threshold, {_COUNTS.format(s='score', t='threshold', y='truth')} FROM {rows}, th GROUP BY threshold),
mm AS (SELECT *, {_RATES} FROM cells) SELECT * FROM mm ORDER BY f1 DESC, recall DESC, threshold LIMIT 1"""


@query(f"WITH {_MSCORES}, own AS (SELECT score, truth FROM ms WHERE method = 'simhash'), {_sql_best('own', metrics.SIMHASH_THRESHOLDS)}")
def simhash_best_threshold(spark, d):
    """The best of 17 thresholds from 0.5 to 0.98 for SimHash scores."""
    return metrics.best_threshold(_methods(spark, d).where("method = 'simhash'").select("score", "truth"), metrics.SIMHASH_THRESHOLDS)


_RANKS = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query(f"""WITH {B.SCORED}, {_MODELS}, r AS (SELECT {_RANKS.format(c='true_sim')} AS x, {_RANKS.format(c='pred_sim')} AS y FROM scored)
SELECT (SELECT round(corr(true_sim, pred_sim), 6) FROM scored) AS pearson, (SELECT round(corr(x, y), 6) FROM r) AS spearman,
(SELECT round(max(f1) FILTER (model = 'cosine') - max(f1) FILTER (model = 'exact'), 6) FROM models) AS f1_over_exact, (SELECT round(max(f1) FILTER (model = 'cosine') - max(f1) FILTER (model = 'hamming'), 6) FROM models) AS f1_over_hamming,
(SELECT round(median(pred_sim) FILTER (is_duplicate = 1), 6) FROM scored) AS duplicate_median, (SELECT round(median(pred_sim) FILTER (is_duplicate = 0), 6) FROM scored) AS other_median""")
def result_report(spark, d):
    """Correlations, what the best model's F1 is above the others', and medians by kind of pair: one row."""
    s = kept(B.scored_pairs(spark, d), "scored")
    f1 = {m: F.max(F.when(F.col("model") == m, F.col("f1"))) for m in ("cosine", "exact", "hamming")}
    gains = _models(spark, d).agg(F.round(f1["cosine"] - f1["exact"], 6).alias("f1_over_exact"), F.round(f1["cosine"] - f1["hamming"], 6).alias("f1_over_hamming"))
    dup = F.col("is_duplicate") == 1
    medians = s.agg(F.round(F.median(F.when(dup, F.col("pred_sim"))), 6).alias("duplicate_median"), F.round(F.median(F.when(~dup, F.col("pred_sim"))), 6).alias("other_median"))  # scores of 65 values
    one = metrics.pearson(s, "true_sim", "pred_sim").crossJoin(metrics.spearman(s, "true_sim", "pred_sim"))  # one row each
    return one.crossJoin(gains).crossJoin(medians)


@query(f"""WITH {B.SCORED}, b AS (SELECT id_1, id_2, code_1, code_2, true_sim, least(9, greatest(0, floor(true_sim * 10)))::INT AS similarity_bin, substring(md5('42|split|' || id_1::VARCHAR || '|' || id_2::VARCHAR), 1, 13) AS o FROM scored),
r AS (SELECT *, row_number() OVER (PARTITION BY similarity_bin ORDER BY o) AS i, floor(count(*) OVER (PARTITION BY similarity_bin) * 0.2 + 0.5) AS a FROM b)
SELECT id_1, id_2, similarity_bin, true_sim, round({B.BLOCK_EQ.format(n=32, w=2)} / 32.0::DOUBLE, 6) AS pred_sim FROM r WHERE i <= a""")
def held_out_correlation(spark, d):
    """True similarity beside group collision for the fifth of every similarity bin that is held out for plots."""
    p = B.scored_pairs(spark, d).withColumn("similarity_bin", T.floor_bin(F.col("true_sim")))
    own = p.select("id_1", "id_2", "similarity_bin", "true_sim", F.round(V.group_collision(F.col("code_1"), F.col("code_2"), 32, 2), 6).alias("pred_sim"))
    return draws.stratified_split(own, "similarity_bin").where("part = 'plot'").drop("part")


@query(f"""WITH {_MSCORES}, t AS (SELECT id_1, id_2, label_1, label_2, round({B.sql_cos('v_1', 'v_2')}, 6) AS true_sim, round({B.BLOCK_EQ.format(n=32, w=2)} / 32.0::DOUBLE, 6) AS groups FROM vp)
SELECT method, ms.id_1, ms.id_2, true_sim, score AS pred_sim, truth AS is_duplicate FROM ms JOIN t ON t.id_1 = ms.id_1 AND t.id_2 = ms.id_2 WHERE method <> 'exact'
UNION ALL SELECT 'groups', id_1, id_2, true_sim, groups, (label_1 = label_2)::INT FROM t""")
def exploratory_stack(spark, d):
    """Three detectors' rows above those of group collision, whose pairs count as duplicates if their labels are equal."""
    p = B.vector_pairs(spark, d)
    true = p.select("id_1", "id_2", F.round(V.cosine01(F.col("v_1"), F.col("v_2")), 6).alias("true_sim"))
    detectors = _methods(spark, d).where("method <> 'exact'").join(true, ["id_1", "id_2"]).select("method", "id_1", "id_2", "true_sim", F.col("score").alias("pred_sim"), F.col("truth").alias("is_duplicate"))
    groups = F.round(V.group_collision(F.col("code_1"), F.col("code_2"), 32, 2), 6)
    paper = p.select(F.lit("groups").alias("method"), "id_1", "id_2", F.round(V.cosine01(F.col("v_1"), F.col("v_2")), 6).alias("true_sim"), groups.alias("pred_sim"), (F.col("label_1") == F.col("label_2")).cast("int").alias("is_duplicate"))
    return detectors.unionByName(paper)


# --- Five measures of token pairs beside five predictors: Hamming and band collision of two codes (SimHash of content tokens, of bigrams), and SimHash of all tokens

#: Kinds of token lists up to which their signatures are broadcast.
KINDS = 200_000

_BIGRAMS = "list_distinct(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]))"
_OWN = "list_distinct(list_filter(tokens, lambda t: NOT starts_with(t, 'label=') AND NOT starts_with(t, 'source=')))"


def _sql_simhash(name: str, tokens: str) -> str:
    """CTE {name} (id, s) of the SimHash of a list of tokens of the flows."""
    body = _SIMHASH[_SIMHASH.index(", c AS") + 2 :].split(" UNION ALL SELECT doc_id, repeat")[0] + ")"
    return f"{name} AS (WITH w AS (SELECT id AS doc_id, unnest({tokens}) AS t FROM tokens), {body} SELECT doc_id AS id, s FROM sig)"


_BANDS = "len(list_filter(range(0, 8), lambda i: substring(x.s, (i * 8 + 1)::INT, 8) = substring(y.s, (i * 8 + 1)::INT, 8))) / 8.0::DOUBLE"


@query(f"""WITH {B.TOKENS}, feat AS (SELECT id, [{', '.join(f'coalesce({f}, 0.0)::DOUBLE' for f in B.FEATURES)}] AS v FROM flows), {_sql_simhash('own_hash', _OWN)}, {_sql_simhash('bigram_hash', _BIGRAMS)}, {_sql_simhash('all_hash', 'tokens')},
pr AS ({B.sql_neighbours('pos', 'label', 4, 'tokens')}), j AS ({SQL['token_jaccard_pairs']}), bj AS ({SQL['bigram_jaccard_pairs']}), tf AS ({SQL['tf_cosine_pairs']}), ti AS ({SQL['tfidf_cosine_pairs']}),
base AS (SELECT pr.id_1, pr.id_2, pr.label_1, pr.label_2, round(1 - hamming(x.s, y.s) / 64.0::DOUBLE, 6) AS content_hamming, round({_BANDS}, 6) AS content_collision, round(1 - hamming(b1.s, b2.s) / 64.0::DOUBLE, 6) AS bigram_hamming,
  round({_BANDS.replace('x.s', 'b1.s').replace('y.s', 'b2.s')}, 6) AS bigram_collision, round(1 - hamming(a1.s, a2.s) / 64.0::DOUBLE, 6) AS simhash_similarity, round({B.sql_cos('f1.v', 'f2.v')}, 6) AS flow_cosine
  FROM pr JOIN own_hash x ON x.id = id_1 JOIN own_hash y ON y.id = id_2 JOIN bigram_hash b1 ON b1.id = id_1 JOIN bigram_hash b2 ON b2.id = id_2 JOIN all_hash a1 ON a1.id = id_1 JOIN all_hash a2 ON a2.id = id_2 JOIN feat f1 ON f1.id = id_1 JOIN feat f2 ON f2.id = id_2)
SELECT metric, id_1, id_2, label_1, label_2, true_sim, content_hamming, content_collision, bigram_hamming, bigram_collision, simhash_similarity, (label_1 = label_2)::INT AS is_duplicate FROM (
  SELECT base.*, unnest(['jaccard', 'jaccard_bigram', 'cosine_tf', 'cosine_tfidf', 'flow_cosine']) AS metric, unnest([j.all_tokens, bj.bigram_jaccard, tf.tf_cosine, ti.tfidf_cosine, flow_cosine]) AS true_sim
  FROM base JOIN j USING (id_1, id_2) JOIN bj USING (id_1, id_2) JOIN tf USING (id_1, id_2) JOIN ti USING (id_1, id_2))""")
def correlation_frame(spark, d):
    """Token pairs under five measures, one row each, with five predictors. Signatures are made once a row, not once a pair."""
    rows = B.flows(spark, d)
    t = kept(B.flow_tokens(spark, d, rows), "tokens")
    # Binned flows have few kinds of token lists: signatures are made once a kind.
    own = F.array_distinct(T.content_tokens(F.col("tokens")))
    kinds_ = t.select("tokens").distinct().select("tokens", S.simhash_md5(own).alias("c"), S.simhash_md5(T.bigrams(F.col("tokens"))).alias("b"), S.simhash_md5("tokens").alias("s"))
    kinds_ = kept(kinds_, "kinds")
    words = t.select("id", "tokens").join(F.broadcast(kinds_) if kinds_.count() <= KINDS else kinds_.hint("merge"), "tokens").select("id", "c", "b", "s")
    v = rows.na.fill(0.0, B.FEATURES).select("id", F.array(*B.FEATURES).alias("v"))
    sides = kept(words.join(v.hint("merge"), "id"), "sides")
    p = kept(pairs.positive(t), "pairs")
    side = lambda n: sides.select(*[F.col(x).alias(f"{x}_{n}") for x in sides.columns]).hint("merge")
    both = p.join(side(1), "id_1").join(side(2), "id_2")
    ti = text_similarity.tfidf_cosine(p.select("id_1", "id_2"), text_similarity.tfidf(t))
    one, two = F.col("tokens_1"), F.col("tokens_2")
    bands = lambda x: V.band_keys(F.col(x), 8, 8)
    same = lambda x: F.size(F.filter(F.zip_with(bands(f"{x}_1"), bands(f"{x}_2"), lambda a, b: a == b), lambda e: e)) / F.lit(8.0)
    near = lambda x: S.similarity_of_bits(F.col(f"{x}_1"), F.col(f"{x}_2"))
    predictors = {"content_hamming": near("c"), "content_collision": same("c"), "bigram_hamming": near("b"), "bigram_collision": same("b"), "simhash_similarity": near("s")}
    measures = {"jaccard": T.jaccard(one, two), "jaccard_bigram": T.jaccard(T.bigrams(one), T.bigrams(two)), "cosine_tf": T.frequency_cosine(one, two), "cosine_tfidf": F.col("tfidf_cosine"), "flow_cosine": V.cosine01(F.col("v_1"), F.col("v_2"))}
    kinds = F.array(*[F.struct(F.lit(m).alias("metric"), F.round(x, 6).alias("true_sim")) for m, x in measures.items()])
    wide = both.join(ti, ["id_1", "id_2"]).select("id_1", "id_2", "label_1", "label_2", F.explode(kinds).alias("m"), *[F.round(x, 6).alias(k) for k, x in predictors.items()])
    return wide.select("m.metric", "id_1", "id_2", "label_1", "label_2", "m.true_sim", *predictors, (F.col("label_1") == F.col("label_2")).cast("int").alias("is_duplicate"))
