"""Nearest signatures against brute force."""

import random

from dupsift.operators import hamming


def test_nearest_is_exact(spark, monkeypatch):
    """Clusters of near signatures, shared ones, and far ones, so that every radius and the last scan are needed."""
    rng = random.Random(5)
    words = [rng.getrandbits(64) for _ in range(30)]
    words += [w ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for w in words[:10] for _ in range(12)] + [words[0]] * 40
    rows = [(3 * i, w - (1 << 64) if w >> 63 else w) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "id bigint, word bigint").repartition(4)
    asked = df.where("id % 2 = 0").selectExpr("id AS q", "word")
    got = {}
    for r in hamming.nearest(df, asked, 7).collect():
        got.setdefault(r["q"], {})[r["rank"]] = (r["id"], r["similarity"])
    for q, w in rows:
        if q % 2 == 0:
            best = sorted(((bin((w ^ x) & (1 << 64) - 1).count("1"), -i) for i, x in rows if i != q))[:7]
            assert [got[q][n] for n in range(1, 8)] == [(-i, round(1 - h / 64, 6)) for h, i in best]
    few = df.where("id < 9")
    assert len(hamming.nearest(few, few.selectExpr("id AS q", "word"), 7).collect()) == 6
    assert hamming.nearest(df.limit(0), asked.limit(0), 3).count() == 0


def test_few_queries_are_like_many(spark, monkeypatch):
    """One pass for a few queries, blocks for many: the same answers, with nulls and shared signatures."""
    rng = random.Random(6)
    rows = [(i, rng.getrandbits(12) if i % 9 else None) for i in range(200)] + [(None, 5)]
    df = spark.createDataFrame(rows, "id bigint, word bigint").repartition(3)
    asked = df.where("id % 40 = 0 OR id = 9 OR id IS NULL").selectExpr("id AS q", "word")
    got = []
    for few in (100, 0):
        monkeypatch.setattr(hamming, "FEW", few)
        got.append(sorted(map(repr, hamming.nearest(df, asked, 5).collect())))
    assert got[0] == got[1] and len(got[0]) == 25
