"""Steps that large tables need, against plain versions."""

import random
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest

from dupsift.functions import tokens as T
from dupsift.operators import lsh, scan, text_similarity
from dupsift.plans import bindings as B
from dupsift.plans import frames

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows", [7, 4096])
def test_sharing_in_blocks(spark, monkeypatch, rows):
    """Pairs with a common band, however the rows are cut into blocks."""
    monkeypatch.setattr(scan, "GROUP_ROWS", rows)
    rng = random.Random(2)
    words = {i: rng.getrandbits(64) & 0x0303030303030303 for i in range(60)}
    signed = [(i, w) for i, w in words.items()]
    equal = lambda x, y: sum((x >> 8 * b & 255) == (y >> 8 * b & 255) for b in range(8))
    want = sorted((a, b, equal(words[a], words[b])) for a in words for b in words if a < b and equal(words[a], words[b]))
    assert sorted(map(tuple, scan.sharing(spark.createDataFrame(signed, "id bigint, word bigint"), 8, 8).collect())) == want


def test_ratio_by_renamed_pairs():
    """Pairs that differ by a renaming share one ratio, that of difflib."""
    known, rng = {}, random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc01") for _ in range(rng.randint(0, 30))) for _ in range(2))
        assert T._ratio(a, b, known) == SequenceMatcher(None, a, b).ratio()
    known.clear()
    assert T._ratio("x=1 y=2", "x=2 y=2", known) == T._ratio("x=3 y=7", "x=7 y=7", known) and len(known) == 1


def test_tfidf_cosine_moves_no_whole_table(spark, monkeypatch):
    """Small and large vocabularies give the same; no side is broadcast, however small its file."""
    rows = [(i, [f"t{i % 7}", f"t{i % 3}", "all"]) for i in range(50)]
    df = spark.createDataFrame(rows, "id bigint, tokens array<string>")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(49)], "id_1 bigint, id_2 bigint")
    found = {}
    for most in (500, 0):
        monkeypatch.setattr(text_similarity, "SMALL_VOCABULARY", most, raising=False)
        out = text_similarity.tfidf_cosine(pairs, text_similarity.tfidf(df))
        found[most] = sorted(map(tuple, out.collect()))
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert found[500] == found[0] and len(found[0]) == 49


def test_flows_are_written_once(spark):
    """What reads flows several times doesn't join orders and lines again."""
    assert not any("lineitem" in f or "orders" in f for f in B.flows(spark, D).inputFiles())


@pytest.mark.parametrize("same_label", [False, True])
@pytest.mark.parametrize("bands, width", [(8, 8), (4, 16), (5, 8)])
def test_top_k_by_index(spark, monkeypatch, same_label, bands, width):
    """Rows found by choices of bands, with crowded codes, few candidates and vectors that aren't whole, are those found by joins; blocks and runs of pairs are cut anyhow."""
    rng = np.random.default_rng(3)
    v = rng.integers(-3, 4, (700, 64)) / 2
    v[100:400] = v[np.arange(300) % 20] + (rng.random((300, 64)) < 0.04) * rng.integers(-2, 3, (300, 64))
    v[400:430] = v[5]
    rows = [(i * 10, x, i % 3) for i, x in enumerate(v.tolist())]
    rows[7][1][3], rows[450], rows[9] = None, (4500, None, 1), (90, [0.0] * 64, 0)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    c = lsh.codes(df, "vec_id", "embedding", "label")
    got = {}
    for block, pairs in ((131_072, 500_000), (150, 40)):
        monkeypatch.setattr(scan, "FOUND_BLOCK", block)
        monkeypatch.setattr(scan, "PAIRS", pairs)
        got[block] = sorted(map(repr, lsh.top_k(c, c, 4, bands, width, same_label).collect()))
    monkeypatch.setattr(scan, "LANES", ())
    assert got[131_072] == got[150] == sorted(map(repr, lsh.top_k(c, c, 4, bands, width, same_label).collect()))


def test_index_spares_pairs():
    """Of random codes few pairs are compared: those of two common bands, unless less than k have any."""
    rng = np.random.default_rng(1)
    words, ids = rng.integers(0, 1 << 63, 40_000, np.int64), np.arange(40_000)
    v = rng.normal(size=(40_000, 64))
    table = lambda s, q: pa.table({f"{q}id": ids[s], f"{q}v": pa.array(list(v[s])), f"{q}word": words[s]})
    cell = scan._Cell(table(slice(0, 300), "q_"), table(slice(None), ""), None)
    compared, of = [], cell.of
    cell.of = lambda i, j: compared.append(len(i)) or of(i, j)
    none = lambda *all_: tuple(np.zeros(0) for _ in range(4))
    for _ in scan._by_hits(cell, none, 3, 8, 8, True):
        pass
    assert 0 < sum(compared) < 300 * 40


def test_jaccard_join_moves_no_set_with_a_pair(spark, monkeypatch):
    """All pairs of clusters, copies, short and odd sets, however keys and sets are dealt; a set goes to a cell once."""
    rng = random.Random(4)
    base = [[f"w{rng.randrange(400)}" for _ in range(n)] for n in (1, 2, 9, 40, 40, 90)]
    rows = [(i, [*(t for t in base[i % 6] if rng.random() > 0.06), *(["rare%d" % i] if i % 3 else [])]) for i in range(150)] + [(900, []), (901, ['"', "\\", " x", "\u0001"]), (902, [" x", "\u0001", "\\", '"']), (903, ["one"])]
    df = spark.createDataFrame(rows, "id bigint, tokens array<string>")
    classes = {}
    for i, t in rows:
        classes.setdefault(frozenset(t), []).append(i)
    sets = {min(i): (s, len(i)) for s, i in classes.items() if s}
    jaccard = lambda x, y: len(x & y) / len(x | y)
    want = sorted((a, b, sets[a][1], sets[b][1], round(j, 6)) for a in sets for b in sets if a < b and (j := jaccard(sets[a][0], sets[b][0])) >= 0.8 - 1e-12)
    for cells, keys, pairs in ((20_000, 3_000_000, 500_000), (9, 40, 7)):
        monkeypatch.setattr(text_similarity, "CELL_SETS", cells)
        monkeypatch.setattr(text_similarity, "PART_KEYS", keys)
        monkeypatch.setattr(text_similarity, "PAIRS", pairs)
        out = text_similarity.jaccard_join(df, 0.8)
        assert sorted(map(tuple, out.collect())) == want and len(want) > 300
    assert "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()


def test_signatures_once_a_kind(spark, monkeypatch):
    """correlation_frame signs each list of tokens once, and gives the same where the kinds are too many to be broadcast."""
    written, keep = {}, frames.kept
    monkeypatch.setattr(frames, "kept", lambda df, label: written.setdefault(label, keep(df, label)))
    frames.correlation_frame(spark, D)
    assert written["kinds"].count() == written["tokens"].select("tokens").distinct().count()
    few = sorted(map(tuple, written["sides"].drop("v").collect()))
    written.clear()
    monkeypatch.setattr(frames, "KINDS", 0)
    frames.correlation_frame(spark, D)
    assert sorted(map(tuple, written["sides"].drop("v").collect())) == few
