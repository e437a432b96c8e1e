"""Stated queries against all rows in blocks, held against one row for each pair."""

import numpy as np
import pytest
from pyspark.sql import DataFrame

from dupsift.operators import lsh, metrics, reports, scan
from dupsift.plans import bindings as B
from dupsift.plans import catalog


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Vectors with copies, zeros, nulls, no numbers, infinite parts, one id twice and null ids."""
    rng = np.random.default_rng(5)
    v = (rng.integers(-3, 4, (400, 64)) / 2).tolist()
    v[7], v[8], v[50], v[60] = v[3], [0.0] * 64, [0.0] * 64, None
    v[70][5], v[80][0], v[90][1], v[100][3] = None, float("nan"), float("inf"), None
    rows = [(i, x, i % 3) for i, x in enumerate(v)] + [(150, v[1], 1), (None, v[2], 2), (450, None, 1)]
    d = str(tmp_path_factory.mktemp("scan"))
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("small", [False, True])
def test_scan(spark, folder, monkeypatch, small):
    if small:
        for name, n in (("GROUP_ROWS", 3), ("BLOCK_ROWS", 20), ("AT_ONCE", 2)):
            monkeypatch.setattr(scan, name, n)
    c, rows = B.coded(spark, folder), B.query_rows(spark, folder).cache()
    assert rows_of(metrics.rates(scan.precision_counts(c, [(8, 1, 8, 8)]))) == rows_of(metrics.precision_recall(rows, 8, 8))
    assert rows_of(metrics.probability(scan.weakest(c, 8, 1), 8, 8)) == rows_of(metrics.weakest_hit(rows, 8, 8))
    assert rows_of(scan.generalized_mrr(c, 8, 1)) == rows_of(metrics.generalized_mrr(rows))
    found = metrics.recall_of_best(scan.best(c, [None, (16, 1), (8, 1), (4, 1)], 10), [1, 2, 3], 10)
    assert rows_of(found) == rows_of(metrics.recall_at_k(rows, [(1, "c1"), (2, "c2"), (3, "c3")], 10))
    near = scan.best(c, [None], 20).select("q", "id", "sim", "place")
    assert rows_of(near.where("q <> 150")) == rows_of(reports.true_neighbours(rows, 20).where("q <> 150"))
    rows.unpersist()


def test_no_row_for_each_pair(spark, folder):
    """What is exchanged after the products is reduced: no plan makes the pairs as rows."""
    for name in ("precision_recall_f", "weakest_hit_prob", "generalized_mrr", "recall_at_k"):
        df: DataFrame = catalog.QUERIES[name](spark, folder)
        assert "FlatMapCoGroupsInArrow" in df._jdf.queryExecution().executedPlan().toString()


def test_lanes():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 2000, np.uint64) & rng.integers(0, 1 << 63, 2000, np.uint64) & rng.integers(0, 1 << 63, 2000, np.uint64)
    for width in (4, 8, 16):
        want = [sum((int(w) >> at) & ((1 << width) - 1) == 0 for at in range(0, 64, width)) for w in x]
        assert scan.equal_lanes(x, width).tolist() == want


@pytest.mark.parametrize("same_label, fallback", [(True, True), (False, True), (False, False)])
def test_top_k(spark, folder, monkeypatch, same_label, fallback):
    """By blocks, without a row for each pair of a bucket; as by joins."""
    monkeypatch.setattr(scan, "BLOCK_ROWS", 70)
    c = B.coded(spark, folder).where("id IS NOT NULL").dropDuplicates(["id"])
    found = lsh.top_k(c, c.where("id % 5 = 0"), 4, 4, 16, same_label, fallback)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(scan, "LANES", ())
    assert rows_of(lsh.top_k(c, c.where("id % 5 = 0"), 4, 4, 16, same_label, fallback)) == rows_of(found)
