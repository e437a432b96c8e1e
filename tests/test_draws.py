"""Places, order statistics and drawn pairs."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dupsift.operators import draws, order


def test_positions_and_sums(spark):
    rng = np.random.default_rng(0)
    values = rng.integers(0, 50, 500).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, v bigint").repartition(5)
    rows = order.with_positions(df, "v", "id").collect()
    assert [r["pos"] for r in sorted(rows, key=lambda r: (r["v"], r["id"]))] == list(range(500))
    sums = {r["id"]: r["before"] for r in order.running_sums(df, "v", "id").collect()}
    assert [sums[i] for i in range(500)] == np.r_[0, np.cumsum(values)[:-1]].tolist()
    assert order.with_positions(df.limit(0), "v").count() == 0 and order.running_sums(df.limit(0), "v", "id").count() == 0


@pytest.mark.parametrize("few", [1, 20_000])
def test_order_statistics(spark, monkeypatch, few):
    """Ties, extreme values, values close together, one value; by refinement alone, and with small intervals counted by value."""
    monkeypatch.setattr(order, "FEW", few)
    rng = np.random.default_rng(1)
    groups = {"a": rng.integers(0, 9, 700).astype(float), "b": np.r_[rng.standard_normal(300), 1e308, -1e308, 1 + 1e-15 * np.arange(50)], "c": np.zeros(40), "d": np.array([2.5])}
    df = spark.createDataFrame([(s, float(v)) for s, x in groups.items() for v in x], "stratum string, value double").repartition(3)
    ranks = {s: sorted({0, len(x) // 3, len(x) // 2, len(x) - 1}) for s, x in groups.items()}
    got = order.order_statistics(df, ranks)
    assert got == {(s, r): float(np.sort(groups[s])[r]) for s, rs in ranks.items() for r in rs}


def test_quantiles(spark):
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal(333), rng.integers(0, 4, 333).astype(float)
    df = spark.createDataFrame([(float(a), float(b), None) for a, b in zip(x, y, strict=True)], "x double, y double, n double")
    points = [i / 8 for i in range(9)]
    got = order.quantiles(df, ["x", "y", "n"], points)
    assert got["x"] == pytest.approx(np.quantile(x, points)) and got["y"] == pytest.approx(np.quantile(y, points)) and got["n"] is None


@pytest.mark.parametrize("n, most", [(100, 7), (100, 100), (5, 120), (1, 3), (50, 1), (0, 4)])
def test_evenly_spaced(spark, n, most):
    df = spark.range(0, 3 * n, 3).repartition(4)
    want = [3 * (i * (n - 1) // max(1, min(most, n) - 1)) for i in range(min(most, n))]
    assert sorted(r["id"] for r in order.evenly_spaced(df, most, "id").collect()) == want


def labelled(spark, sizes, first=0):
    rows = [(first + 7 * i, label) for i, label in enumerate(x for x, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "id bigint, label string").repartition(3)


def chi_square(counts, kinds):
    expected = sum(counts.values()) / kinds
    return (sum((c - expected) ** 2 for c in counts.values()) + (kinds - len(counts)) * expected) / expected


def test_positives_are_exact_and_uniform(spark):
    """Labels equally likely, and within a label its 28 pairs: below the 99.9 % points of chi-square with 2 and 27 degrees of freedom."""
    df = labelled(spark, {"a": 8, "b": 40, "c": 200, "single": 1})
    rows = draws.positives(df, 24).collect()
    assert len({(r["id_1"], r["id_2"]) for r in rows}) == 24 and all(r["id_1"] < r["id_2"] and r["label_1"] == r["label_2"] for r in rows)
    groups = draws.members(df, "label", 2)
    numbers = spark.range(3000).withColumnRenamed("id", "k").withColumn("g", draws.number(42, "pos", F.col("k"), 0) % 3)
    drawn = draws._rows_of(draws.within(groups[1], numbers, 42, "pos"), groups[0], True).collect()
    assert len(drawn) == 3000
    assert chi_square(Counter(r["label_1"] for r in drawn), 3) < 13.8
    assert chi_square(Counter((r["id_1"], r["id_2"]) for r in drawn if r["label_1"] == "a"), 28) < 55.5


def test_positives_fill_up_where_labels_run_out(spark):
    """Label a has one pair; 60 labels share the draws, so most must come from the fill, by ordinal or by number."""
    df = labelled(spark, {"big": 60} | {f"s{i}": 2 for i in range(60)})
    for target in (400, 1_700, 1_830, 5_000):
        rows = draws.positives(df, target).collect()
        assert len({(r["id_1"], r["id_2"]) for r in rows}) == len(rows) == min(target, 60 * 59 // 2 + 60)
        assert len({r["k"] for r in rows}) == len(rows)
    assert draws.positives(labelled(spark, {"a": 1, "b": 1}), 5).count() == 0 and draws.positives(df.limit(0), 5).count() == 0


def test_fill_draws_every_pair_equally(spark):
    """Ordinals over labels of very different sizes: 10, 45 and 190 pairs, all equally likely."""
    df = labelled(spark, {"a": 5, "b": 10, "c": 20})
    rows, groups = draws.members(df, "label", 2)
    none = draws.positives(df, 0)
    counts = Counter()
    for seed in range(15):
        found = draws.fill(spark, rows, groups, none, 60, 245, seed).collect()
        assert len({(r["id_1"], r["id_2"]) for r in found}) == 60
        counts.update(r["label_1"] for r in found)
    share = np.array([counts[x] for x in "abc"]) / 900
    assert np.abs(share - np.array([10, 45, 190]) / 245).max() < 0.05


def test_negatives(spark):
    df = labelled(spark, {"a": 5, "b": 50, "c": 3})
    some = draws.negatives(df, 30)
    rows = some.collect()
    assert len({(r["id_1"], r["id_2"]) for r in rows}) == 30 and all(r["label_1"] != r["label_2"] for r in rows)
    more = draws.negatives(df, 100, chosen=some).collect()
    assert len(more) == 100 and not {(r["id_1"], r["id_2"]) for r in more} & {(r["id_1"], r["id_2"]) for r in rows}
    assert draws.negatives(labelled(spark, {"a": 9}), 5).count() == 0


def tokened(spark, n=300):
    rng = np.random.default_rng(3)
    rows = [(i, "xyz"[i % 3], ["label=q", *[f"t{j}={rng.integers(0, 2)}" for j in range(12)]], [float(i % 4), 1.0]) for i in range(n)]
    return spark.createDataFrame([*rows, (n, "x", ["label=q"], [0.0, 0.0])], "id bigint, label string, tokens array<string>, v array<double>")


def test_training_pairs(spark):
    df = tokened(spark)
    rows = draws.training_pairs(df, 200, "hard").collect()
    by = Counter(r["negative_strategy"] for r in rows)
    assert by["positive"] == 100 and by["hard"] == 100 and sorted(r["place"] for r in rows) == list(range(200))
    assert all(0.3 <= r["token_jaccard"] <= 0.5 and r["target_similarity"] == 0 and r["label_1"] != r["label_2"] for r in rows if r["negative_strategy"] == "hard")
    short = draws.training_pairs(df, 200, "hard", low=0.9, high=1.0).collect()
    by = Counter(r["negative_strategy"] for r in short)
    assert len(short) == 200 == len({(r["id_1"], r["id_2"]) for r in short}) and by["random"] > 0 and sum(by.values()) == 200
    assert Counter(r["negative_strategy"] for r in draws.training_pairs(df, 61).collect()) == {"positive": 30, "random": 31}
    for bad in ({"max_pairs": 0}, {"max_pairs": 5, "strategy": "odd"}):
        with pytest.raises(ValueError):
            draws.training_pairs(df, **bad)


def test_guided_pairs_fill_every_bin(spark):
    """Random pairs of these rows lie between 0.1 and 0.6; the guides reach the bins above."""
    df = tokened(spark)
    rows = draws.guided_pairs(df, 200, least_bins=8, draws=2_000, rounds=3).collect()
    assert len({(r["id_1"], r["id_2"]) for r in rows}) == len(rows) == 200
    sets = {r["id"]: {t for t in r["tokens"] if not t.startswith("label=")} for r in df.collect()}
    for r in rows:
        a, b = sets[r["id_1"]], sets[r["id_2"]]
        assert r["true_sim"] == (len(a & b) / len(a | b) if a | b else 0) and r["similarity_bin"] == min(9, int(r["true_sim"] * 10))
    by = Counter(r["similarity_bin"] for r in rows)
    exist = Counter(min(9, int(10 * (len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 0))) for a in sets for b in sets if a < b)
    assert all(by[x] >= min(20, exist[x]) for x in range(10)), (by, exist)
    with pytest.raises(ValueError):
        draws.guided_pairs(df.limit(3), 200, draws=100, rounds=2)


def test_stratified_split(spark):
    pairs = spark.createDataFrame([(i, i + 1, x) for i, x in enumerate(["a"] * 103 + ["b"] * 7 + [None] * 10 + ["c"])], "id_1 bigint, id_2 bigint, bin string")
    got = Counter((r["bin"], r["part"]) for r in draws.stratified_split(pairs, "bin").collect())
    assert got == {("a", "plot"): 21, ("a", "validation"): 16, ("a", "train"): 66, ("b", "plot"): 1, ("b", "validation"): 1, ("b", "train"): 5, (None, "plot"): 2, (None, "validation"): 2, (None, "train"): 6, ("c", "train"): 1}
