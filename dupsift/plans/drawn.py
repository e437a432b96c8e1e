"""Registered queries: pairs drawn for training, their strata and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as T
from ..operators import clean, draws
from . import bindings as B
from .catalog import _CONTENT, _SQL_JACCARD, query


def sql_number(kind: str, k: str, which: int) -> str:
    return f"('0x' || substring(md5('42|{kind}|' || ({k})::VARCHAR || '|{which // 2}'), {1 + 15 * (which % 2)}, 15))::BIGINT"


def sql_members(source: str, key: str = "label", least: int = 1, name: str = "m") -> str:
    """CTEs {name} (g, pos, id, label, n) and {name}g (g, n)."""
    return f"""{name}0 AS (SELECT id, label, {key} AS key, row_number() OVER (PARTITION BY {key} ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY {key}) AS n FROM {source}),
{name} AS (SELECT id, label, pos, n, dense_rank() OVER (ORDER BY key) - 1 AS g FROM {name}0 WHERE n >= {least}), {name}g AS (SELECT g, any_value(n) AS n FROM {name} GROUP BY g)"""


_PAIR = "least(a.id, b.id) AS id_1, greatest(a.id, b.id) AS id_2, CASE WHEN a.id < b.id THEN a.label ELSE b.label END AS label_1, CASE WHEN a.id < b.id THEN b.label ELSE a.label END AS label_2"


def sql_within(kind: str, drawn: str, name: str = "m") -> str:
    """Rows of draws (k, g) within groups: k, id_1, id_2, label_1, label_2."""
    i = f"{sql_number(kind, 'k', 1)} % n"
    return f"""SELECT k, {_PAIR} FROM (SELECT k, g, {i} AS i, ({i} + 1 + {sql_number(kind, 'k', 2)} % (n - 1)) % n AS j FROM {drawn} JOIN {name}g USING (g)) d
  JOIN {name} a ON a.g = d.g AND a.pos = i JOIN {name} b ON b.g = d.g AND b.pos = j"""


def sql_across(kind: str, attempts: int, name: str = "m") -> str:
    n = f"(SELECT count(*) FROM {name}g)"
    one = f"{sql_number(kind, 'k', 0)} % {n}"
    return f"""SELECT k, {_PAIR} FROM (SELECT k, g1, g2, {sql_number(kind, 'k', 2)} % x.n AS i, {sql_number(kind, 'k', 3)} % y.n AS j FROM
  (SELECT k, {one} AS g1, ({one} + 1 + {sql_number(kind, 'k', 1)} % ({n} - 1)) % {n} AS g2 FROM range(0, {attempts}) t(k)) JOIN {name}g x ON x.g = g1 JOIN {name}g y ON y.g = g2) d
  JOIN {name} a ON a.g = g1 AND a.pos = i JOIN {name} b ON b.g = g2 AND b.pos = j"""


def sql_first(drawn: str, most: int, columns: str = "id_1, id_2, label_1, label_2") -> str:
    return f"SELECT {columns} FROM (SELECT min(k) AS k, {columns} FROM ({drawn}) GROUP BY ALL) ORDER BY k LIMIT {most}"


_POS = f"SELECT k, {sql_number('pos', 'k', 0)} % (SELECT count(*) FROM mg) AS g FROM range(0, {{attempts}}) t(k)"


@query(f"WITH {B.EMB}, {sql_members('emb', least=2)}, d AS ({_POS.format(attempts=30_000)}) {sql_first(sql_within('pos', 'd'), 1000)}")
def pairs_drawn_positive(spark, d):
    """1,000 pairs of one label, drawn uniformly."""
    return draws.positives(B.vectors(spark, d).select("id", "label"), 1000).drop("k")


@query(f"WITH {B.EMB}, {sql_members('emb')} {sql_first(sql_across('neg', 30_000), 1000)}")
def pairs_drawn_negative(spark, d):
    """1,000 pairs of different labels, drawn uniformly."""
    return draws.negatives(B.vectors(spark, d).select("id", "label"), 1000).drop("k")


_SETS = f"{B.TOKENS}, own AS (SELECT id, label, {_CONTENT} AS t FROM tokens)"
_WITH_J = f"SELECT p.*, {_SQL_JACCARD.format(a='x.t', b='y.t')} AS token_jaccard FROM ({{pairs}}) p JOIN own x ON x.id = id_1 JOIN own y ON y.id = id_2"


def sql_hard(target: int, attempts: int, low: float, high: float) -> str:
    scored = _WITH_J.format(pairs=f"SELECT min(k) AS k, * EXCLUDE (k) FROM ({sql_across('hard', attempts)}) GROUP BY ALL")
    return f"SELECT id_1, id_2, label_1, label_2, token_jaccard FROM ({scored}) WHERE token_jaccard BETWEEN {low} AND {high} ORDER BY k LIMIT {target}"


@query(f"WITH {_SETS}, {sql_members('own')} SELECT id_1, id_2, label_1, label_2, round(token_jaccard, 6) AS token_jaccard FROM ({sql_hard(300, 150_000, 0.3, 0.5)})")
def pairs_drawn_hard(spark, d):
    """300 pairs of different labels whose content tokens have a Jaccard similarity in [0.3, 0.5]."""
    found = draws.hard_negatives(B.flow_tokens(spark, d), 300)
    return found.drop("k").withColumn("token_jaccard", F.round("token_jaccard", 6))


def _features(spark, d):
    """id, label, tokens, v of the flows."""
    rows = B.flows(spark, d)
    tokens, v = B.flow_tokens(spark, d, rows), F.array(*[F.coalesce(c, F.lit(0.0)) for c in B.FEATURES])
    return tokens.join(rows.select("id", v.alias("v")).hint("merge"), "id")


_FEATURES = f"feat AS (SELECT id, [{', '.join(f'coalesce({f}, 0.0)::DOUBLE' for f in B.FEATURES)}] AS v FROM flows)"
# Content tokens share 'one' always, so that similarities within [0.6, 0.65] don't exist and all negatives but none are hard ones.
_TRAINING = f"""WITH {_SETS}, {_FEATURES}, {sql_members('own', least=2)}, {sql_members('own', name='w')}, d AS ({_POS.format(attempts=9000)}),
p AS (SELECT *, 'positive' AS negative_strategy FROM ({sql_first(sql_within('pos', 'd'), 300)})),
h AS (SELECT id_1, id_2, label_1, label_2, 'hard' AS negative_strategy FROM ({sql_hard(300, 150_000, 0.99, 1.0).replace('JOIN mg', 'JOIN wg').replace('FROM mg', 'FROM wg').replace('JOIN m ', 'JOIN w ')})),
r AS (SELECT *, 'random' AS negative_strategy FROM (SELECT id_1, id_2, label_1, label_2 FROM (SELECT min(k) AS k, id_1, id_2, label_1, label_2 FROM ({sql_across('neg', 9000, 'w')}) GROUP BY ALL) n ANTI JOIN h USING (id_1, id_2) ORDER BY k LIMIT (SELECT 300 - count(*) FROM h))),
x AS (SELECT * FROM p UNION ALL SELECT * FROM h UNION ALL SELECT * FROM r)
SELECT row_number() OVER (ORDER BY md5('42|shuffle|' || id_1::VARCHAR || '|' || id_2::VARCHAR), id_1, id_2) - 1 AS place, id_1, id_2, label_1, label_2,
CASE negative_strategy WHEN 'positive' THEN round({B.sql_cos('a.v', 'b.v')}, 6) ELSE 0.0 END AS target_similarity, round(token_jaccard, 6) AS token_jaccard, negative_strategy, (negative_strategy = 'positive')::INT AS is_duplicate
FROM ({_WITH_J.format(pairs='SELECT * FROM x')}) q JOIN feat a ON a.id = id_1 JOIN feat b ON b.id = id_2"""


@query(_TRAINING)
def pairs_training(spark, d):
    """600 training pairs of flows: same label, hard negatives of equal content tokens, random ones for what those lack."""
    found = draws.training_pairs(_features(spark, d), 600, "hard", low=0.99, high=1.0)
    return found.withColumns({c: F.round(c, 6) for c in ("target_similarity", "token_jaccard")})


_GUIDES = {"set": ("own", "array_to_string(t, ' ')", 1000), "label": ("own", "label", 5000), "token": ("(SELECT id, label, unnest(t) AS token FROM own)", "token", 1000), "all": ("own", "''", 0)}


def _sql_guide(name: str) -> tuple[str, str]:
    source, key, cap = _GUIDES[name]
    each = 20_000 if name == "all" else f"least({cap}, greatest(1, 4 * n))"
    drawn = f"(SELECT g, g::VARCHAR || ':' || t::VARCHAR AS k FROM (SELECT g, unnest(range(0, {each})) AS t FROM {name}_g))"
    members = sql_members(source, key, 2, f"{name}_")
    return members, f"SELECT id_1, id_2, label_1, label_2 FROM ({sql_within(f'guide-{name}', drawn, f'{name}_')})"


_PARTS = [_sql_guide(n) for n in _GUIDES]


@query(f"""WITH {_SETS}, {', '.join(m for m, _ in _PARTS)}, c AS ({' UNION '.join(s for _, s in _PARTS)}),
b AS (SELECT id_1, id_2, label_1, label_2, token_jaccard AS true_sim, least(9, greatest(0, floor(token_jaccard * 10)))::INT AS similarity_bin, substring(md5('42|bin|' || id_1::VARCHAR || '|' || id_2::VARCHAR), 1, 13) AS o FROM ({_WITH_J.format(pairs='SELECT * FROM c')})),
r AS (SELECT *, row_number() OVER (PARTITION BY similarity_bin ORDER BY o) <= 50 AS own FROM b)
SELECT id_1, id_2, label_1, label_2, round(true_sim, 6) AS true_sim, similarity_bin FROM r ORDER BY own DESC, o, id_1, id_2 LIMIT 500""")
def pairs_guided(spark, d):
    """500 pairs of flows over ten bins of similarity, one round of the guides. (Flows of five tokens have similarities in five bins only.)"""
    found = draws.guided_pairs(B.flow_tokens(spark, d), 500, least_bins=5, draws=20_000, rounds=1)
    return found.withColumn("true_sim", F.round("true_sim", 6))


@query(f"""WITH {B.SCORED}, b AS (SELECT id_1, id_2, least(9, greatest(0, floor(true_sim * 10)))::INT AS similarity_bin, substring(md5('42|split|' || id_1::VARCHAR || '|' || id_2::VARCHAR), 1, 13) AS o FROM scored),
r AS (SELECT *, row_number() OVER (PARTITION BY similarity_bin ORDER BY o) AS i, floor(count(*) OVER (PARTITION BY similarity_bin) * 0.2 + 0.5)::BIGINT AS a, count(*) OVER (PARTITION BY similarity_bin) AS n FROM b)
SELECT id_1, id_2, similarity_bin, CASE WHEN i <= a THEN 'plot' WHEN i <= a + floor((n - a) * 0.2 + 0.5) THEN 'validation' ELSE 'train' END AS part FROM r""")
def pairs_split_stratified(spark, d):
    """Shares of every similarity bin, exact to the row."""
    p = B.scored_pairs(spark, d).select("id_1", "id_2", T.floor_bin(F.col("true_sim")).alias("similarity_bin"))
    return draws.stratified_split(p, "similarity_bin")
