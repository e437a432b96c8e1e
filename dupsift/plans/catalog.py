"""The registered queries over the reference operators, each beside its SQL. QUERIES: name to function; SQL: name to DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signatures as S
from ..functions import tokens as T
from ..functions import vectors as V
from ..operators import clean, lsh, metrics, pairs, scan, tasks, text_similarity
from ..sources import flows as sources
from ..storage import kept
from . import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# --- Ingest and cleaning


@query("SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1")
def label_histogram(spark, d):
    return B.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n"))


@query("""SELECT CASE o_orderkey % 4 WHEN 0 THEN 'Web Attack - XSS' WHEN 1 THEN 'Web Attack - Sql Injection' WHEN 2 THEN 'Web Attack - Brute Force' ELSE o_orderpriority END AS label, count(*) AS n
FROM orders GROUP BY 1""")
def label_normalize(spark, d):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, " Web Attack – XSS ").when(k == 1, "Web Attack � Sql Injection").when(k == 2, "Web Attack – Brute Force ").otherwise(F.concat(F.lit(" "), "o_orderpriority"))
    return B.table(spark, d, "orders").groupBy(clean.normalize_label(raw).alias("label")).agg(F.count("*").alias("n"))


@query(f"WITH {B.FLOWS} SELECT id, round(coalesce(total, (SELECT median(total) FROM flows)), 6) AS total FROM flows")
def median_impute(spark, d):
    return clean.impute_median(B.flows(spark, d), ["total"]).select("id", F.round("total", 6).alias("total"))


@query(f"WITH {B.FLOWS} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(DISTINCT {c}) > 1 AS kept FROM flows" for c in B.FEATURES))
def drop_constant_columns(spark, d):
    return clean.distinct_counts(B.flows(spark, d), B.FEATURES)


@query(
    f"WITH {B.FLOWS}, filled AS (SELECT id, n_lines, qty, max_price, coalesce(total, (SELECT median(total) FROM flows)) AS total, one FROM flows) SELECT id, "
    + ", ".join(f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END, 6) + 0.0 AS {c}" for c in B.FEATURES)
    + " FROM filled"
)
def standard_scale(spark, d):
    scaled = clean.standardize(clean.impute_median(B.flows(spark, d), ["total"]), B.FEATURES)
    return scaled.select("id", *[(F.round(c, 6) + 0.0).alias(c) for c in B.FEATURES])


@query(f"WITH {B.FLOWS}, {B.EDGES} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, i::INT AS place, round(e_{c}[i + 1], 6) AS edge FROM edges, range(0, 9) r(i) WHERE i < len(e_{c})" for c in B.FEATURES))
def quantile_edges(spark, d):
    edges = clean.bin_edges(B.flows(spark, d).na.fill(0.0, B.FEATURES), B.FEATURES)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit([float(x) for x in e]).alias("e")) for c, e in edges.items()])
    one = spark.range(1).select(F.explode(rows).alias("r")).select("r.feature", F.posexplode("r.e").alias("place", "edge"))
    return one.select("feature", "place", F.round("edge", 6).alias("edge"))


@query(f"WITH {B.TOKENS} SELECT id, array_to_string(tokens, ' ') AS token_sequence, len(tokens)::INT AS sequence_length FROM tokens")
def tokenize_bins(spark, d):
    return B.flow_tokens(spark, d).select("id", F.array_join("tokens", " ").alias("token_sequence"), F.size("tokens").alias("sequence_length"))


@query(f"WITH {B.TOKENS} SELECT token, (row_number() OVER (ORDER BY token) + 1)::INT AS token_id FROM (SELECT DISTINCT unnest(tokens) AS token FROM tokens)")
def vocab_ids(spark, d):
    return clean.vocabulary(B.flow_tokens(spark, d))


@query(f"""WITH {B.TOKENS}, vocab AS (SELECT token, row_number() OVER (ORDER BY token) + 1 AS token_id FROM (SELECT DISTINCT unnest(tokens) AS token FROM tokens)),
x AS (SELECT id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM tokens)
SELECT id, string_agg(token_id::VARCHAR, ' ' ORDER BY pos) || ' 0 0 0' AS ids FROM x JOIN vocab USING (token) GROUP BY id""")
def encode_sequences(spark, d):
    t = B.flow_tokens(spark, d)
    return clean.encode(t, clean.vocabulary(t), 10).select("id", F.array_join("ids", " ").alias("ids"))


@query(f"""WITH {B.FLOWS}, n AS (SELECT label, row_number() OVER (ORDER BY label) AS k FROM (SELECT DISTINCT label FROM flows))
SELECT id, label FROM (SELECT id, label, k, row_number() OVER (PARTITION BY label ORDER BY md5('42|sample|' || id::VARCHAR), id) AS r FROM flows JOIN n USING (label)) WHERE r <= CASE WHEN k < 5 THEN 101 ELSE 98 END""")
def balanced_sample(spark, d):
    return clean.balanced_sample(B.flows(spark, d).select("id", "label"), 502)


@query("""SELECT event_id, event_type AS attack_type, event_id::VARCHAR || ' | ' || user_id::VARCHAR || ' | ' || event_type || ' | ' || props AS raw_text FROM events ORDER BY event_id LIMIT 5""")
def import_preview(spark, d):
    raw = B.table(spark, d, "events").select("event_id", "user_id", "event_type", "props").withColumnRenamed("event_type", "Label")
    rows = sources.upload_rows(raw).withColumn("event_id", F.split("raw_text", r" \| ")[0].cast("bigint"))
    return sources.preview(rows, "event_id").select("event_id", "attack_type", "raw_text")


# --- Pairs

_V4 = "round({}, 6) AS target_similarity".format(B.sql_cos("v_1", "v_2"))


@query(f"WITH {B.PAIRS} SELECT id_1, id_2, label_1, label_2, {_V4} FROM vp WHERE is_duplicate = 1")
def pairs_positive(spark, d):
    p = pairs.positive(B.vectors(spark, d))
    return p.select("id_1", "id_2", "label_1", "label_2", F.round(V.cosine01(F.col("v_1"), F.col("v_2")), 6).alias("target_similarity"))


@query(f"WITH {B.PAIRS} SELECT id_1, id_2, label_1, label_2, 0.0::DOUBLE AS target_similarity FROM pairs WHERE is_duplicate = 0")
def pairs_negative(spark, d):
    return pairs.negative(B.vectors(spark, d)).select("id_1", "id_2", "label_1", "label_2", F.lit(0.0).alias("target_similarity"))


_CONTENT = "list_sort(list_distinct(list_filter(tokens, lambda t: NOT starts_with(t, 'label=') AND NOT starts_with(t, 'source='))))"
_SQL_JACCARD = "len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::DOUBLE"


@query(
    f"WITH {B.TOKENS}, own AS (SELECT id, label, {_CONTENT} AS t FROM tokens), drawn AS ("
    + " UNION ALL ".join(f"SELECT * FROM ({B.sql_neighbours('hard', '', 16, 'own', k)}) WHERE label_1 <> label_2" for k in range(1, 6))
    + f"), j AS (SELECT d.*, round({_SQL_JACCARD.format(a='a.t', b='b.t')}, 6) AS token_jaccard FROM drawn d JOIN own a ON a.id = id_1 JOIN own b ON b.id = id_2) SELECT * FROM j WHERE token_jaccard BETWEEN 0.3 AND 0.5"
)
def pairs_hard_negative(spark, d):
    return pairs.hard_negative(B.flow_tokens(spark, d)).select("id_1", "id_2", "label_1", "label_2", "token_jaccard")


@query(f"""WITH {B.PAIRS} SELECT id_1, id_2, label_1, label_2, CASE is_duplicate WHEN 1 THEN round({B.sql_cos('v_1', 'v_2')}, 6) ELSE 0.0 END AS target_similarity,
CASE is_duplicate WHEN 1 THEN 'positive' ELSE 'random' END AS negative_strategy, is_duplicate FROM vp""")
def pairs_assembled(spark, d):
    v = B.vectors(spark, d)
    return pairs.assemble(pairs.positive(v), pairs.negative(v), F.round(V.cosine01(F.col("v_1"), F.col("v_2")), 6))


@query(f"""WITH {B.SCORED}, b AS (SELECT id_1, id_2, true_sim, least(9, greatest(0, floor(true_sim * 10)))::INT AS similarity_bin, md5('42|bin|' || id_1::VARCHAR || '|' || id_2::VARCHAR) AS o FROM scored),
r AS (SELECT *, row_number() OVER (PARTITION BY similarity_bin ORDER BY o, id_1, id_2) AS n FROM b)
SELECT id_1, id_2, true_sim, similarity_bin FROM r ORDER BY CASE WHEN n <= 20 THEN 0 ELSE 1 END, o, id_1, id_2 LIMIT 200""")
def pairs_stratified(spark, d):
    return pairs.stratified(B.scored_pairs(spark, d).select("id_1", "id_2", "true_sim"), 200)


@query(f"""WITH {B.PAIRS}, u AS (SELECT id_1, id_2, is_duplicate, ('0x' || substring(md5('42|split|' || id_1::VARCHAR || '|' || id_2::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM pairs)
SELECT id_1, id_2, is_duplicate, CASE WHEN u < 0.2 THEN 'plot' WHEN u < 0.36 THEN 'validation' ELSE 'train' END AS part FROM u""")
def pair_split(spark, d):
    return pairs.split(B.vector_pairs(spark, d).select("id_1", "id_2", "is_duplicate"), "is_duplicate")


@query(f"""WITH {B.PAIRS}, o AS (SELECT least(id_1, id_2) AS i, greatest(id_1, id_2) AS j, (SELECT count(*) FROM emb) AS n FROM pairs)
SELECT i, j, (i * (2 * n - i - 1) // 2 + j - i - 1)::BIGINT AS place FROM o""")
def pair_index(spark, d):
    """The condensed place of each pair, and the pair got back from the place."""
    n = B.table(spark, d, "embeddings").count()
    placed = B.vector_pairs(spark, d).select(V.pair_index(F.col("id_1"), F.col("id_2"), n).alias("place"))
    i, j = V.pair_of_index(F.col("place"), n)
    return placed.select(i.alias("i"), j.alias("j"), "place")


# --- Similarities of pairs


def _vector_pair_query(name: str, column, sql: str) -> None:
    def f(spark, d):
        return B.vector_pairs(spark, d).select("id_1", "id_2", F.round(column(), 6).alias(name))

    f.__name__ = name
    QUERIES[name] = f
    SQL[name] = f"WITH {B.PAIRS} SELECT id_1, id_2, round({sql}, 6) AS {name} FROM vp"


_C = lambda: (F.col("code_1"), F.col("code_2"))
_X = lambda: (F.col("v_1"), F.col("v_2"))
_vector_pair_query("cosine01_pairs", lambda: V.cosine01(*_X()), B.sql_cos("v_1", "v_2"))
_vector_pair_query("hamming_pairs", lambda: V.hamming_similarity(*_C()), B.HAM)
_vector_pair_query("block_hamming", lambda: V.block_hamming(*_C(), 16, 4), B.BLOCK_EQ.format(n=16, w=4) + " / 16.0::DOUBLE")
_vector_pair_query("group_collision", lambda: V.group_collision(*_C(), 32, 2), B.BLOCK_EQ.format(n=32, w=2) + " / 32.0::DOUBLE")
_vector_pair_query("band_collision", lambda: V.band_collision(*_C(), 8, 2, 4), B.BLOCK_EQ.format(n=8, w=8) + " / 8.0::DOUBLE")
_vector_pair_query("soft_block_hamming", lambda: V.soft_block_hamming(*_X(), 16, 4), "1 - list_sum(list_transform(range(0, 16), lambda i: greatest(" + ", ".join(f"abs(v_1[i * 4 + {k}] - v_2[i * 4 + {k}])" for k in range(1, 5)) + "))) * 4 / 128.0")
_vector_pair_query("manhattan_sim", lambda: V.manhattan_similarity(*_X()), "exp(-0.005 * list_sum(list_transform(range(1, 65), lambda i: abs(v_1[i] - v_2[i]))))")
_vector_pair_query("contrastive_losses", lambda: V.contrastive_loss(F.col("is_duplicate").cast("double"), V.cosine01(*_X())), "is_duplicate * 0.5 * pow(1 - {c}, 2) + (1 - is_duplicate) * 0.5 * pow(greatest(0.0, 0.7 - (1 - {c})), 2)".format(c=B.sql_cos("v_1", "v_2")))


@query(f"WITH {B.EMB} SELECT id, round(list_sum(list_transform(v, lambda x: pow(abs(x) - 1, 2))) / 64, 6) AS loss FROM emb")
def quantization_losses(spark, d):
    return B.vectors(spark, d).select("id", F.round(V.quantization_loss(F.col("v")), 6).alias("loss"))


_TPAIRS = f"{B.TOKENS}, tp AS (SELECT p.*, a.tokens AS t_1, b.tokens AS t_2 FROM ({B.sql_neighbours('pos', 'label', 4, 'tokens')}) p JOIN tokens a ON a.id = id_1 JOIN tokens b ON b.id = id_2)"


def _token_pairs(spark, d):
    return pairs.positive(B.flow_tokens(spark, d))


@query(f"WITH {_TPAIRS}, s AS (SELECT id_1, id_2, {_CONTENT.replace('tokens', 't_1')} AS a, {_CONTENT.replace('tokens', 't_2')} AS b, list_distinct(t_1) AS c, list_distinct(t_2) AS e FROM tp) SELECT id_1, id_2, round({_SQL_JACCARD.format(a='a', b='b')}, 6) AS content, round({_SQL_JACCARD.format(a='c', b='e')}, 6) AS all_tokens FROM s")
def token_jaccard_pairs(spark, d):
    """Both Jaccards: without and with the label and source tokens."""
    one, two = F.col("tokens_1"), F.col("tokens_2")
    return _token_pairs(spark, d).select("id_1", "id_2", F.round(T.jaccard(T.content_tokens(one), T.content_tokens(two)), 6).alias("content"), F.round(T.jaccard(one, two), 6).alias("all_tokens"))


@query(f"WITH {_TPAIRS}, s AS (SELECT id_1, id_2, list_distinct(list_transform(range(1, len(t_1)), lambda i: t_1[i] || ' ' || t_1[i + 1])) AS a, list_distinct(list_transform(range(1, len(t_2)), lambda i: t_2[i] || ' ' || t_2[i + 1])) AS b FROM tp) SELECT id_1, id_2, round({_SQL_JACCARD.format(a='a', b='b')}, 6) AS bigram_jaccard FROM s")
def bigram_jaccard_pairs(spark, d):
    return _token_pairs(spark, d).select("id_1", "id_2", F.round(T.jaccard(T.bigrams(F.col("tokens_1")), T.bigrams(F.col("tokens_2"))), 6).alias("bigram_jaccard"))


@query(f"""WITH {_TPAIRS}, c AS (SELECT id, token, count(*) AS n FROM (SELECT id, unnest(tokens) AS token FROM tokens) GROUP BY ALL), l AS (SELECT id, sqrt(sum(n * n)) AS l FROM c GROUP BY id),
both_have AS (SELECT id_1, id_2, unnest(list_intersect(t_1, t_2)) AS token FROM tp),
x AS (SELECT h.id_1, h.id_2, sum(a.n * b.n) AS s FROM both_have h JOIN c a ON a.id = h.id_1 AND a.token = h.token JOIN c b ON b.id = h.id_2 AND b.token = h.token GROUP BY ALL)
SELECT tp.id_1, tp.id_2, round(coalesce(s / (a.l * b.l), 0.0), 6) AS tf_cosine FROM tp LEFT JOIN x USING (id_1, id_2) JOIN l a ON a.id = tp.id_1 JOIN l b ON b.id = tp.id_2""")
def tf_cosine_pairs(spark, d):
    return _token_pairs(spark, d).select("id_1", "id_2", F.round(T.frequency_cosine(F.col("tokens_1"), F.col("tokens_2")), 6).alias("tf_cosine"))


# The tokens of a sequence are distinct, so a weight is the token's idf.
@query(f"""WITH {_TPAIRS}, c AS (SELECT id, unnest(tokens) AS token FROM tokens), idf AS (SELECT token, ln((1 + (SELECT count(*) FROM tokens)) / (1 + count(*))::DOUBLE) + 1 AS w FROM c GROUP BY token),
l AS (SELECT id, sqrt(sum(w * w)) AS l FROM c JOIN idf USING (token) GROUP BY id), common AS (SELECT id_1, id_2, unnest(list_intersect(t_1, t_2)) AS token FROM tp),
x AS (SELECT id_1, id_2, sum(w * w) AS s FROM common JOIN idf USING (token) GROUP BY ALL)
SELECT tp.id_1, tp.id_2, round(coalesce(s / (a.l * b.l), 0.0), 6) AS tfidf_cosine FROM tp LEFT JOIN x USING (id_1, id_2) JOIN l a ON a.id = tp.id_1 JOIN l b ON b.id = tp.id_2""")
def tfidf_cosine_pairs(spark, d):
    t = kept(B.flow_tokens(spark, d), "tokens")
    return text_similarity.tfidf_cosine(pairs.positive(t.select("id", "label")).select("id_1", "id_2"), text_similarity.tfidf(t))


@query()
def sequence_ratio_pairs(spark, d):
    return _token_pairs(spark, d).select("id_1", "id_2", F.round(T.sequence_ratio(F.array_join("tokens_1", " "), F.array_join("tokens_2", " ")), 6).alias("ratio"))


_DOC_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"


def _doc_words(spark, d):
    return B.table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.words(F.col("text")).alias("tokens"))


# Plainly: every pair of texts with a common word, by the words that both have.
@query(f"""WITH s AS (SELECT min(doc_id) AS id, count(*) AS n, s FROM (SELECT doc_id, list_sort(list_distinct({_DOC_WORDS})) AS s FROM documents) WHERE len(s) > 0 GROUP BY s),
x AS (SELECT id, unnest(s) AS token FROM s), i AS (SELECT a.id AS a, b.id AS b, count(*) AS i FROM x a JOIN x b ON a.token = b.token AND a.id < b.id GROUP BY ALL),
j AS (SELECT i.a, i.b, a.n AS n_a, b.n AS n_b, i / (len(a.s) + len(b.s) - i)::DOUBLE AS jaccard FROM i JOIN s a ON a.id = i.a JOIN s b ON b.id = i.b)
SELECT a, b, n_a, n_b, round(jaccard, 6) AS jaccard FROM j WHERE jaccard >= 0.8 - 1e-12""")
def jaccard_pairs(spark, d):
    return text_similarity.jaccard_join(_doc_words(spark, d), 0.8)


# --- Signatures


@query("SELECT md5(text) AS md5, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, d):
    return text_similarity.exact_groups(B.table(spark, d, "documents").withColumnRenamed("doc_id", "id"))


@query("SELECT count(*)::BIGINT AS rows, count(DISTINCT md5(text)) AS kinds, round(1 - count(DISTINCT md5(text)) / count(*)::DOUBLE, 6) AS compression_rate FROM documents")
def compression_rate(spark, d):
    return text_similarity.compression_rate(B.table(spark, d, "documents").select(F.md5("text").alias("m")), "m")


_SIMHASH = f"""w AS (SELECT doc_id, unnest({_DOC_WORDS}) AS t FROM documents), c AS (SELECT doc_id, ('0x' || substring(md5(t), 1, 16))::UBIGINT AS h, count(*) AS n FROM w GROUP BY ALL),
bits AS (SELECT doc_id, {", ".join(f"(2 * sum(CASE WHEN (h >> {i}) & 1 = 1 THEN n ELSE 0 END) >= sum(n)) AS b{i}" for i in range(64))} FROM c GROUP BY doc_id),
sig AS (SELECT doc_id, {" || ".join(f"(CASE WHEN b{i} THEN '1' ELSE '0' END)" for i in range(63, -1, -1))} AS s FROM bits UNION ALL SELECT doc_id, repeat('1', 64) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM c))"""


def _doc_simhash(spark, d):
    return _doc_words(spark, d).select("id", S.simhash_md5("tokens").alias("word"))


@query(f"WITH {_SIMHASH} SELECT doc_id, s AS simhash FROM sig")
def simhash_signatures(spark, d):
    return _doc_simhash(spark, d).select(F.col("id").alias("doc_id"), F.lpad(F.bin("word"), 64, "0").alias("simhash"))


@query(f"""WITH {_SIMHASH}, g AS (SELECT min(doc_id) AS id, s FROM sig GROUP BY s), k AS (SELECT id, s, c.a AS a, c.b AS b, substring(s, c.a * 16 + 1, 16) || substring(s, c.b * 16 + 1, 16) AS key FROM g, (VALUES (0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)) c(a, b))
SELECT DISTINCT x.id AS a, y.id AS b, round(1 - hamming(x.s, y.s) / 64.0::DOUBLE, 6) AS similarity FROM k x JOIN k y ON x.a = y.a AND x.b = y.b AND x.key = y.key AND x.id < y.id""")
def simhash_pairs(spark, d):
    """Pairs that agree in two of four slots, with their similarity."""
    c = lsh.classes(_doc_simhash(spark, d))
    p = lsh.combo_candidates(c, 4, 2)
    left, right = c.select(F.col("id").alias("a"), F.col("word").alias("x")), c.select(F.col("id").alias("b"), F.col("word").alias("y"))
    return p.join(left, "a").join(right, "b").select("a", "b", F.round(S.similarity_of_bits(F.col("x"), F.col("y")), 6).alias("similarity"))


@query(f"""WITH {B.EMB}, k AS (SELECT id, a, b, array_to_string(code[a * 16 + 1 : a * 16 + 16] || code[b * 16 + 1 : b * 16 + 16], '') AS key FROM (SELECT min(id) AS id, code FROM emb GROUP BY code), (VALUES (0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)) c(a, b))
SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y ON x.a = y.a AND x.b = y.b AND x.key = y.key AND x.id < y.id""")
def simhash_combo_candidates(spark, d):
    return lsh.combo_candidates(B.coded(spark, d), 4, 2)


@query(f"""WITH {B.TOKENS}, h AS (SELECT id, list_transform(tokens, lambda t: ('0x' || substring(md5(t), 1, 8))::BIGINT % {S.PRIME}) AS h FROM tokens)
SELECT id, array_to_string([{", ".join(f"list_min(list_transform(h, lambda x: (x * {a} + {b}) % {S.PRIME}))" for a, b in S.minhash_parameters(8))}], ' ') AS minhash FROM h""")
def minhash_signatures(spark, d):
    return B.flow_tokens(spark, d).select("id", F.array_join(S.minhash(F.col("tokens"), 8).cast("array<string>"), " ").alias("minhash"))


@query()
def fnv_simhash(spark, d):
    return _doc_words(spark, d).select(F.col("id").alias("doc_id"), S.simhash_fnv("tokens").alias("simhash"))


# --- LSH retrieval

_HITS = f"{B.EMB}, {B.BAND}, hits AS (SELECT a.id AS q, b.id AS id, count(*) AS hits FROM bands a JOIN bands b ON a.band = b.band AND a.key = b.key AND a.id <> b.id {{same}} GROUP BY ALL)"


def _sql_top(same: bool, k: int = 10, fallback: str = "") -> str:
    return f"""WITH {_HITS.format(same='AND a.label = b.label' if same else '')}{fallback}, s AS (SELECT q, h.id, a.label AS ql, b.label AS cl, hits, round({B.sql_cos('a.v', 'b.v')}, 6) AS similarity FROM {'allhits' if fallback else 'hits'} h JOIN emb a ON a.id = q JOIN emb b ON b.id = h.id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY hits DESC, similarity DESC, id)::INT AS rank FROM s)
SELECT q AS query_id, id AS candidate_id, ql AS query_label, cl AS candidate_label, hits AS hash_bucket_hits, similarity, (ql = cl)::INT AS is_same_label, rank FROM r WHERE rank <= {k}"""


_FALL = ", allhits AS (SELECT q, id, hits FROM hits UNION ALL SELECT a.id, b.id, 0 FROM emb a JOIN emb b ON a.id <> b.id {same} WHERE a.id NOT IN (SELECT q FROM hits))"


@query(_sql_top(True, 10, _FALL.format(same="AND a.label = b.label")))
def lsh_topk(spark, d):
    c = B.coded(spark, d)
    return lsh.top_k(c, c, 10, B.BANDS, B.WIDTH, same_label=True)


@query(_sql_top(False, 10, _FALL.format(same="")))
def topk_all_labels(spark, d):
    c = B.coded(spark, d)
    return lsh.top_k(c, c, 10, B.BANDS, B.WIDTH, same_label=False)


@query(_sql_top(True, 5, _FALL.format(same="AND a.label = b.label")).replace(f"range(0, {B.BANDS}) r(b)", "range(0, 4) r(b)").replace(f"code[b * {B.WIDTH} + 1 : b * {B.WIDTH} + {B.WIDTH}]", "code[b * 16 + 1 : b * 16 + 16]"))
def topk_fallback_scan(spark, d):
    """Bands so wide that most queries have no candidates."""
    c = B.coded(spark, d)
    return lsh.top_k(c, c, 5, 4, 16, same_label=True)


@query(f"WITH {_HITS.format(same='AND a.label = b.label')} SELECT id, label FROM emb WHERE id NOT IN (SELECT q FROM hits)")
def query_without_candidates(spark, d):
    c = B.coded(spark, d)
    return lsh.without_candidates(c, c, B.BANDS, B.WIDTH)


@query(f"WITH {B.EMB}, {B.BAND} SELECT band::INT AS band, id, n FROM bands JOIN (SELECT band, key, count(*) AS n FROM bands GROUP BY ALL HAVING count(*) > 1) USING (band, key)")
def lsh_buckets(spark, d):
    return lsh.buckets(B.coded(spark, d), B.BANDS, B.WIDTH).select("band", "id", "n")


@query(f"WITH {B.EMB}, cls AS (SELECT min(id) AS id, 0 AS label, code FROM emb GROUP BY code), {B.BAND.replace('FROM emb', 'FROM cls')} SELECT a.id AS a, b.id AS b, count(*) AS hits FROM bands a JOIN bands b ON a.band = b.band AND a.key = b.key AND a.id < b.id GROUP BY ALL")
def lsh_candidates(spark, d):
    return lsh.candidates(B.coded(spark, d), B.BANDS, B.WIDTH)


_GRID = [(1, 1), (1, 5), (1, 10), (1, 20), (2, 20), (4, 20)]


@query(f"WITH {B.SCORED} SELECT id_1, id_2, true_sim, " + ", ".join(f"round(least(1.0, greatest(0.0, 1 - pow(1 - pow(true_sim, {k}), {n}))), 6) AS k{k}_l{n}" for k, n in _GRID) + " FROM scored")
def lsh_prob_grid(spark, d):
    return B.scored_pairs(spark, d).select("id_1", "id_2", "true_sim", *[F.round(V.lsh_probability(F.col("true_sim"), k, n), 6).alias(f"k{k}_l{n}") for k, n in _GRID])


# --- Evaluation

_RATES = "round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0)::DOUBLE, 0), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1"
_COUNTS = "count(*) FILTER ({s} >= {t} AND {y} = 1) AS tp, count(*) FILTER ({s} < {t} AND {y} <> 1) AS tn, count(*) FILTER ({s} >= {t} AND {y} <> 1) AS fp, count(*) FILTER ({s} < {t} AND {y} = 1) AS fn"


def _as_scores(df: DataFrame, score: str = "pred_sim") -> DataFrame:
    return df.select("id_1", "id_2", F.col(score).alias("score"), F.col("is_duplicate").alias("truth"))


@query(f"WITH {B.SCORED}, c AS (SELECT {_COUNTS.format(s='pred_sim', t='0.5', y='is_duplicate')} FROM scored) SELECT *, {_RATES} FROM c")
def confusion_metrics(spark, d):
    return metrics.confusion(_as_scores(B.scored_pairs(spark, d)), 0.5)


def _sql_sweep(score: str, thresholds: list[float]) -> str:
    return f"WITH {B.SCORED}, th(threshold) AS (VALUES {', '.join(f'({t}::DOUBLE)' for t in thresholds)}), c AS (SELECT threshold, {_COUNTS.format(s=score, t='threshold', y='is_duplicate')} FROM scored, th GROUP BY threshold), m AS (SELECT *, {_RATES} FROM c)"


@query(_sql_sweep("pred_sim", metrics.DEFAULT_THRESHOLDS) + " SELECT * FROM m")
def threshold_sweep(spark, d):
    return metrics.sweep(_as_scores(B.scored_pairs(spark, d)), metrics.DEFAULT_THRESHOLDS)


@query(_sql_sweep("pred_sim", metrics.DEFAULT_THRESHOLDS) + " SELECT * FROM m ORDER BY f1 DESC, recall DESC, threshold LIMIT 1")
def best_threshold(spark, d):
    return metrics.best_threshold(_as_scores(B.scored_pairs(spark, d)), metrics.DEFAULT_THRESHOLDS)


@query(
    _sql_sweep("pred_sim", metrics.DEFAULT_THRESHOLDS).replace("WITH ", "WITH ")
    + f", c2 AS (SELECT threshold, {_COUNTS.format(s='true_sim', t='threshold', y='is_duplicate')} FROM scored, th GROUP BY threshold), m2 AS (SELECT *, {_RATES} FROM c2),"
    + " a AS (SELECT 'hamming' AS model, * FROM (SELECT * FROM m ORDER BY f1 DESC, recall DESC, threshold LIMIT 1) UNION ALL SELECT 'cosine' AS model, * FROM (SELECT * FROM m2 ORDER BY f1 DESC, recall DESC, threshold LIMIT 1)) SELECT * FROM a ORDER BY f1 DESC, recall DESC, precision DESC, model LIMIT 1"
)
def best_model(spark, d):
    s = B.scored_pairs(spark, d)
    both = [metrics.best_threshold(_as_scores(s, c), metrics.DEFAULT_THRESHOLDS).withColumn("model", F.lit(m)) for m, c in (("hamming", "pred_sim"), ("cosine", "true_sim"))]
    return metrics.best_model(both[0].unionByName(both[1]))


_ENTROPY = "ent AS (SELECT b::INT AS bit, count(*) AS n, avg((code[b + 1] > 0)::INT) AS p FROM emb, range(0, 64) r(b) GROUP BY b), st AS (SELECT bit, n, round(2 * p - 1, 6) AS mean_value, round(p, 6) AS positive_rate, round(-(p * log2(p + 1e-12) + (1 - p) * log2(1 - p + 1e-12)), 6) AS entropy FROM ent)"


@query(f"WITH {B.EMB}, {_ENTROPY} SELECT * FROM st")
def bit_entropy(spark, d):
    return metrics.bit_stats(B.vectors(spark, d), 64)


@query(f"WITH {B.EMB}, {_ENTROPY}, one AS (SELECT round(avg(entropy), 6) AS mean_entropy, count(*) FILTER (entropy < 0.1) AS low_bits, round(avg((entropy < 0.1)::INT), 6) AS low_ratio FROM st) SELECT *, (mean_entropy < 0.3 OR low_ratio > 0.25)::INT AS warning FROM one")
def hash_collapse(spark, d):
    return metrics.collapse_warning(metrics.bit_stats(B.vectors(spark, d), 64))


@query(f"WITH {B.SCORED} SELECT is_duplicate, count(*) AS n, round(avg(pred_sim), 6) AS mean_sim, round(median(pred_sim), 6) AS median_sim, count(*) FILTER (pred_sim >= 0.9) AS n_high FROM scored GROUP BY is_duplicate")
def pair_sim_by_label(spark, d):
    p = F.col("pred_sim")
    return B.scored_pairs(spark, d).groupBy("is_duplicate").agg(F.count("*").alias("n"), F.round(F.avg(p), 6).alias("mean_sim"), F.round(F.median(p), 6).alias("median_sim"), F.count_if(p >= 0.9).alias("n_high"))


@query(f"WITH {B.SCORED} SELECT round(corr(true_sim, pred_sim), 6) AS pearson FROM scored")
def pearson(spark, d):
    return metrics.pearson(B.scored_pairs(spark, d), "true_sim", "pred_sim")


@query(f"WITH {B.SCORED}, r AS (SELECT rank() OVER (ORDER BY true_sim) + (count(*) OVER (PARTITION BY true_sim) - 1) / 2.0 AS x, rank() OVER (ORDER BY pred_sim) + (count(*) OVER (PARTITION BY pred_sim) - 1) / 2.0 AS y FROM scored) SELECT round(corr(x, y), 6) AS spearman FROM r")
def spearman(spark, d):
    return metrics.spearman(B.scored_pairs(spark, d), "true_sim", "pred_sim")


@query(f"""WITH {B.SCORED}, c AS (SELECT round(true_sim, 2) AS x, pred_sim AS y, count(*)::DOUBLE AS n FROM scored GROUP BY ALL), s AS (SELECT sum(sign(b.y - a.y) * a.n * b.n) AS s FROM c a JOIN c b ON a.x < b.x),
tx AS (SELECT sum(n * (n - 1) / 2) AS tx FROM (SELECT sum(n) AS n FROM c GROUP BY x)), ty AS (SELECT sum(n * (n - 1) / 2) AS ty FROM (SELECT sum(n) AS n FROM c GROUP BY y)), w AS (SELECT sum(n) * (sum(n) - 1) / 2 AS a FROM c)
SELECT round(s / sqrt((a - tx) * (a - ty)), 6) AS kendall_tau FROM s, tx, ty, w""")
def kendall_tau(spark, d):
    return metrics.kendall(B.scored_pairs(spark, d).withColumn("true_sim", F.round("true_sim", 2)), "true_sim", "pred_sim")


def _sql_calibration(pred: str) -> str:
    band = {"mid": "true_sim >= 0.4 AND true_sim < 0.7", "high": "true_sim >= 0.8"}
    parts = [f"avg(abs({pred} - true_sim)) AS mae"] + [f"count(*) FILTER ({on}) AS {n}_count, avg(true_sim) FILTER ({on}) AS {n}_t, avg({pred}) FILTER ({on}) AS {n}_p" for n, on in band.items()]
    gaps = ", ".join(f"coalesce(abs({n}_p - {n}_t), 1.0) AS {n}_gap" for n in band)
    return f"SELECT round(mae, 6) AS mae, " + ", ".join(f"{n}_count, round(coalesce({n}_t, 0), 6) AS {n}_true, round(coalesce({n}_p, 0), 6) AS {n}_pred, round({n}_gap, 6) AS {n}_gap" for n in band) + f", round(mae + mid_gap + high_gap, 6) AS recommendation FROM (SELECT *, {gaps} FROM (SELECT {', '.join(parts)} FROM scored))"


@query(f"WITH {B.SCORED} {_sql_calibration('pred_sim')}")
def calibration_summary(spark, d):
    return metrics.calibration(B.scored_pairs(spark, d))


@query(f"WITH {B.SCORED} SELECT least(9, greatest(0, floor(true_sim * 10)))::INT AS bin, count(*) AS n, round(avg(true_sim), 6) AS mean_true, round(avg(pred_sim), 6) AS mean_pred FROM scored GROUP BY 1")
def calibration_curve(spark, d):
    return metrics.calibration_curve(B.scored_pairs(spark, d))


@query(f"WITH {B.SCORED}, g AS (SELECT greatest(0, ceil(true_sim * 10) - 1)::INT AS bin, count(*) AS n, round(avg(true_sim), 6) AS mean_true, round(avg(pred_sim), 6) AS mean_pred FROM scored GROUP BY 1) SELECT b::INT AS bin, coalesce(n, 0) AS n, mean_true, mean_pred FROM range(0, 10) r(b) LEFT JOIN g ON bin = b")
def right_closed_bins(spark, d):
    return metrics.calibration_curve(B.scored_pairs(spark, d), right_closed=True)


@query(
    f"WITH {B.SCORED}, x AS ("
    + " UNION ALL ".join(f"SELECT {k} AS k, {n} AS l, * FROM ({_sql_calibration(f'least(1.0, greatest(0.0, 1 - pow(1 - pow(true_sim, {k}), {n})))')})" for k, n in _GRID)
    + ") SELECT k, l, mae, recommendation FROM x ORDER BY recommendation, mae, k, l LIMIT 1"
)
def lsh_recommend(spark, d):
    s = B.scored_pairs(spark, d)
    # One scan: every grid point's prediction is a row of an exploded array.
    grid = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("l"), V.lsh_probability(F.col("true_sim"), k, n).alias("pred_sim")) for k, n in _GRID])
    t = s.select("true_sim", F.explode(grid).alias("g")).select("true_sim", "g.*")
    p, tr = F.col("pred_sim"), F.col("true_sim")
    gap = lambda on: F.coalesce(F.abs(F.avg(F.when(on, p)) - F.avg(F.when(on, tr))), F.lit(1.0))
    out = t.groupBy("k", "l").agg(F.avg(F.abs(p - tr)).alias("mae"), gap((tr >= 0.4) & (tr < 0.7)).alias("mid"), gap(tr >= 0.8).alias("high"))
    out = out.select("k", "l", F.round("mae", 6).alias("mae"), F.round(F.col("mae") + F.col("mid") + F.col("high"), 6).alias("recommendation"))
    return out.orderBy("recommendation", "mae", "k", "l").limit(1)


_SHAPES = [(1, 16), (2, 8), (4, 4), (8, 2), (16, 1)]


@query(
    f"WITH {B.PAIRS}, f AS (SELECT *, ('0x' || substring(md5('42|fold|' || id_1::VARCHAR || '|' || id_2::VARCHAR), 1, 8))::BIGINT % 5 AS fold FROM vp), x AS ("
    + " UNION ALL ".join(f"SELECT {n} AS l, {k} AS k, fold, is_duplicate, i / {n}.0::DOUBLE AS threshold, round({B.BLOCK_EQ.format(n=n, w=4 * k)} / {n}.0::DOUBLE, 6) AS s FROM f, range(0, {n + 1}) r(i)" for n, k in _SHAPES)
    + f"), c AS (SELECT l, k, fold::INT AS fold, round(threshold, 6) AS threshold, {_COUNTS.format(s='s', t='threshold', y='is_duplicate')} FROM x GROUP BY ALL), m AS (SELECT *, {_RATES} FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY l, k, fold ORDER BY f1 DESC, recall DESC, threshold) AS n FROM m) SELECT l, k, fold, threshold, accuracy, precision, recall, f1 FROM r WHERE n = 1"
)
def fold_best_f1(spark, d):
    fold = (F.conv(F.substring(clean.md5_order("42|fold", "id_1", "id_2"), 1, 8), 16, 10).cast("bigint") % 5).cast("int")
    p = B.vector_pairs(spark, d).withColumn("fold", fold)
    out = None
    for n, k in _SHAPES:
        s = p.select("fold", F.round(V.band_collision(F.col("code_1"), F.col("code_2"), n, k, 4), 6).alias("score"), F.col("is_duplicate").alias("truth"))
        one = metrics.best_threshold(s, metrics.spread(0.0, 1.0, n + 1), ["fold"]).select(F.lit(n).alias("l"), F.lit(k).alias("k"), "fold", "threshold", "accuracy", "precision", "recall", "f1")
        out = one if out is None else out.union(one)
    return out


@query(f"""WITH {B.SCORED}, both_ways AS (SELECT q, id, max(score) AS score, max(truth) AS truth FROM (SELECT id_1 AS q, id_2 AS id, pred_sim AS score, is_duplicate AS truth FROM scored UNION ALL SELECT id_2, id_1, pred_sim, is_duplicate FROM scored) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS n FROM both_ways WHERE q IN (SELECT q FROM both_ways WHERE truth = 1)),
p AS (SELECT q, min(n) FILTER (truth = 1) AS first, {", ".join(f"count(*) FILTER (truth = 1 AND n <= {k}) AS n{k}" for k in (1, 5, 10))} FROM r GROUP BY q)
SELECT count(*) AS queries, round(avg(1 / first::DOUBLE), 6) AS mrr, {", ".join(f"round(avg((n{k} > 0)::INT), 6) AS hit_at_{k}, round(avg(n{k} / {k}.0::DOUBLE), 6) AS precision_at_{k}" for k in (1, 5, 10))} FROM p""")
def retrieval_report(spark, d):
    return metrics.retrieval_report(_as_scores(B.scored_pairs(spark, d)), [1, 5, 10])


_TRUE = "(least(1.0, greatest(0.0, 1 - pow(1 - pow(sim, 8), 8))) >= 0.5)"


@query(f"""WITH {B.QROWS}, g AS (SELECT q, count(*) FILTER (candidate = 1) AS n, count(*) FILTER (candidate = 1 AND {_TRUE}) AS h, count(*) FILTER ({_TRUE}) AS t FROM qrows GROUP BY q), pr AS (SELECT q, n, h / nullif(n, 0)::DOUBLE AS p, h / nullif(t, 0)::DOUBLE AS r FROM g)
SELECT q, n AS n_candidates, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p IS NULL OR r IS NULL THEN NULL WHEN p = 0 OR r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS fscore FROM pr""")
def precision_recall_f(spark, d):
    return metrics.rates(scan.precision_counts(B.coded(spark, d), [(8, 1, 8, 8)]))


@query(f"WITH {B.QROWS}, g AS (SELECT q, min(sim) FILTER (candidate = 1) AS s FROM qrows GROUP BY q) SELECT q, round(1 - pow(1 - pow(s, 8), 8), 6) AS probability FROM g")
def weakest_hit_prob(spark, d):
    return metrics.probability(scan.weakest(B.coded(spark, d), 8, 1), 8, 8)


@query(f"""WITH {B.QROWS}, r AS (SELECT *, rank() OVER (PARTITION BY q ORDER BY sim DESC) AS r FROM qrows), c AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS i FROM r WHERE candidate = 1),
m AS (SELECT q, round(avg(CASE WHEN i > r THEN 1.0 ELSE (i + 1) / (r + 1)::DOUBLE END), 6) AS mrr FROM c GROUP BY q) SELECT q, mrr FROM (SELECT DISTINCT q FROM qrows) LEFT JOIN m USING (q)""")
def generalized_mrr(spark, d):
    return scan.generalized_mrr(B.coded(spark, d), 8, 1)


@query(
    f"WITH {B.QROWS}, t AS (SELECT q, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS n FROM qrows), best AS (SELECT q, sim, count(*) AS m FROM t WHERE n <= 10 GROUP BY ALL), "
    + ", ".join(f"k{n} AS (SELECT q, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS n FROM qrows WHERE c{n} = 1)" for n in (1, 2, 3))
    + ", lv AS (SELECT q, min(level) AS level FROM ("
    + " UNION ALL ".join(f"SELECT q, {n} AS level FROM k{n} GROUP BY q HAVING count(*) >= 10" for n in (1, 2, 3))
    + ") GROUP BY q), ch AS (SELECT q, sim, count(*) AS m FROM ("
    + " UNION ALL ".join(f"SELECT k.q, k.sim FROM k{n} k JOIN lv ON lv.q = k.q AND level = {n} WHERE n <= 10" for n in (1, 2, 3))
    + ") GROUP BY ALL), s AS (SELECT q, sum(least(b.m, c.m)) / 10.0 AS recall FROM best b JOIN ch c USING (q, sim) GROUP BY q) SELECT a.q, level, round(coalesce(recall, 0.0)::DOUBLE, 6) AS recall FROM (SELECT DISTINCT q FROM qrows) a LEFT JOIN lv USING (q) LEFT JOIN s USING (q)"
)
def recall_at_k(spark, d):
    return metrics.recall_of_best(scan.best(B.coded(spark, d), [None, (16, 1), (8, 1), (4, 1)], 10), [1, 2, 3], 10)


@query(f"WITH {B.SCORED}, c AS (SELECT 'hamming' AS model, {_COUNTS.format(s='pred_sim', t='0.5', y='is_duplicate')} FROM scored), m AS (SELECT *, {_RATES} FROM c) UNPIVOT (SELECT model, accuracy, precision, recall, f1 FROM m) ON accuracy, precision, recall, f1 INTO NAME metric VALUE value")
def metrics_unpivot(spark, d):
    m = metrics.confusion(_as_scores(B.scored_pairs(spark, d)), 0.5).withColumn("model", F.lit("hamming"))
    return m.unpivot(["model"], ["accuracy", "precision", "recall", "f1"], "metric", "value")


@query(f"WITH {B.SCORED}, b AS (SELECT least(9, greatest(0, floor(true_sim * 10)))::INT AS bin, is_duplicate FROM scored) SELECT bin, count(*) FILTER (is_duplicate = 0) AS different_label, count(*) FILTER (is_duplicate = 1) AS same_label FROM b GROUP BY bin")
def label_bin_pivot(spark, d):
    s = B.scored_pairs(spark, d).select(T.floor_bin(F.col("true_sim")).alias("bin"), F.when(F.col("is_duplicate") == 1, "same_label").otherwise("different_label").alias("kind"))
    return s.groupBy("bin").pivot("kind", ["different_label", "same_label"]).agg(F.count("bin")).na.fill(0)


# --- Tasks and dashboards


@query(f"WITH t AS ({_sql_top(True, 10, _FALL.format(same='AND a.label = b.label'))}) SELECT query_label, count(*) AS total_logs, count(*) FILTER (similarity >= 0.6) AS redundant_logs, round(count(*) FILTER (similarity >= 0.6) * 100.0::DOUBLE / count(*), 2) AS compression_rate FROM t GROUP BY query_label")
def redundancy_task_stats(spark, d):
    return tasks.task_stats(tasks.task_results(lsh_topk(spark, d), 0.6), "query_label")


@query("""WITH t AS (SELECT user_id, count(*) AS total_logs, CASE WHEN user_id % 3 = 0 THEN NULL ELSE count(*) / 10.0::DOUBLE END AS c, CASE WHEN user_id % 5 = 0 THEN NULL ELSE min(event_id) / 100.0::DOUBLE END AS l FROM events GROUP BY user_id)
SELECT count(*) AS tasks, sum(total_logs)::BIGINT AS logs, count(*) FILTER (user_id % 7 <> 0) AS not_failed, round(avg(c), 2) AS mean_compression, round(avg(l), 2) AS mean_latency FROM t""")
def overview_stats(spark, d):
    """A user's events as a task."""
    t = B.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("total_logs"), F.min("event_id").alias("e"))
    u = F.col("user_id")
    return tasks.overview(t.select(F.when(u % 7 == 0, "FAILED").otherwise("SUCCESS").alias("status"), "total_logs", F.when(u % 3 != 0, F.col("total_logs") / 10).alias("compression_rate"), F.when(u % 5 != 0, F.col("e") / 100).alias("latency")))


@query("SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY min(event_id))::INT AS place FROM events GROUP BY event_type")
def attack_type_counts(spark, d):
    return tasks.type_counts(B.table(spark, d, "events"), "event_type", "event_id")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 5")
def recent_top5(spark, d):
    return tasks.recent(B.table(spark, d, "events"), "ts", "event_id").select("event_id", "user_id", "event_type")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, floor(epoch(ts) / 86400) ORDER BY ts, event_id) = 1")
def keep_earliest_per_window(spark, d):
    e = B.table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return tasks.keep_per_window(e, ["user_id", "event_type"], "ts", 86400).select("user_id", "event_type", "event_id")
