"""Pairs of neighbours in MD5 order, whatever the size of a group."""

import hashlib

import pytest

from dupsift.operators import pairs


def plain_neighbours(rows, kind, by_label, salts, ahead):
    groups = {}
    for i, label in rows:
        o = hashlib.md5(f"42|{kind}|{i}".encode()).hexdigest()
        groups.setdefault((label if by_label else None, int(o[:2], 16) % salts), []).append((o, i))
    out = []
    for g in groups.values():
        g = [i for _, i in sorted(g)]
        out += [(a, b) for n, a in enumerate(g) for b in g[n + 1 : n + 1 + ahead]]
    return sorted(out)


@pytest.mark.parametrize("piece_rows", [1, 3, 40, 100_000])
def test_neighbours(spark, monkeypatch, piece_rows):
    """Groups that are ordered in pieces give the pairs that one window a salt gives."""
    monkeypatch.setattr(pairs, "PIECE_ROWS", piece_rows, raising=False)
    monkeypatch.setattr(pairs, "SALT_ROWS", piece_rows, raising=False)  # its name where groups were cut
    rows = [(i, "a" if i % 3 else "b" if i % 2 else "c") for i in range(700)] + [(1000 + i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "id bigint, label string").repartition(3)
    found = lambda *a: sorted((r["id_1"], r["id_2"]) for r in pairs._neighbours(df, *a).collect())
    assert found("neg", [], 16, 42) == plain_neighbours(rows, "neg", False, 16, 1)
    assert found("hard", [], 16, 42, 5) == plain_neighbours(rows, "hard", False, 16, 5)
    known = [r for r in rows if r[1] is not None]
    df = spark.createDataFrame(known, "id bigint, label string")
    assert found("pos", ["label"], 4, 42) == plain_neighbours(known, "pos", True, 4, 1)
