"""Column functions against plain formulas."""

import difflib
import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dupsift.functions import signatures as S
from dupsift.functions import tokens as T
from dupsift.functions import vectors as V

QUICK = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


def one(spark, schema, row, *columns):
    return tuple(spark.createDataFrame([row], schema).select(*columns).first())


@QUICK
@given(st.lists(st.sampled_from("abcde"), max_size=8), st.lists(st.sampled_from("abcde"), max_size=8))
def test_jaccard_and_frequency(spark, a, b):
    x, y = set(a), set(b)
    ca, cb = Counter(a), Counter(b)
    cos = sum(ca[t] * cb[t] for t in ca) / math.sqrt(sum(v * v for v in ca.values()) * sum(v * v for v in cb.values())) if a and b else 0.0
    ba, bb = set(zip(a, a[1:], strict=False)), set(zip(b, b[1:], strict=False))
    got = one(spark, "a array<string>, b array<string>", (a, b), T.jaccard(F.col("a"), F.col("b")), T.jaccard(F.col("b"), F.col("a")), T.frequency_cosine(F.col("a"), F.col("b")), T.jaccard(T.bigrams(F.col("a")), T.bigrams(F.col("b"))))
    want = len(x & y) / len(x | y) if x | y else 0.0
    assert got == pytest.approx((want, want, cos, len(ba & bb) / len(ba | bb) if ba | bb else 0.0))


@QUICK
@given(st.lists(st.floats(-1, 1), min_size=8, max_size=8), st.lists(st.floats(-1, 1), min_size=8, max_size=8))
def test_vector_similarities(spark, a, b):
    x, y = np.array(a), np.array(b)
    cx, cy = np.where(x > 0, 1, -1), np.where(y > 0, 1, -1)
    size = math.sqrt(x @ x) * math.sqrt(y @ y)
    a_, b_ = F.col("a"), F.col("b")
    ca, cb = V.sign_code(a_), V.sign_code(b_)
    got = one(spark, "a array<double>, b array<double>", (a, b), V.cosine01(a_, b_), V.hamming_similarity(ca, cb), V.block_hamming(ca, cb, 4, 2), V.soft_block_hamming(a_, b_, 4, 2), V.manhattan_similarity(a_, b_), V.quantization_loss(a_))
    blocks = (cx == cy).reshape(4, 2).all(1).mean()
    soft = 1 - (np.abs(x - y).reshape(4, 2).max(1) * 2).sum() / 16
    want = ((np.clip(x @ y / size, -1, 1) + 1) / 2 if size else 0.5, (cx == cy).mean(), blocks, soft, math.exp(-0.005 * np.abs(x - y).sum()), ((np.abs(x) - 1) ** 2).mean())
    assert got == pytest.approx(want, abs=1e-9)


def test_zero_vector_rules(spark):
    a = F.col("a")
    assert one(spark, "a array<double>", ([0.0, 0.0],), V.cosine01(a, a), V.cosine01(a, a, zero=0.0)) == (0.5, 0.0)


def test_packed_codes(spark):
    v = [1.0, -1.0] * 32
    word, keys = one(spark, "a array<double>", (v,), V.packed(V.sign_code(F.col("a"))), V.band_keys(V.packed(V.sign_code(F.col("a"))), 8, 8))
    assert word & (2**64 - 1) == int("10" * 32, 2) and keys == [0b10101010] * 8


def test_pair_index_round_trip(spark):
    n = 37
    places = spark.range(n * (n - 1) // 2).select(F.col("id").alias("p"))
    i, j = V.pair_of_index(F.col("p"), n)
    rows = places.select("p", i.alias("i"), j.alias("j")).select("p", "i", "j", V.pair_index(F.col("i"), F.col("j"), n).alias("q")).collect()
    want = [(i, j) for i in range(n) for j in range(i + 1, n)]
    assert [(r["i"], r["j"]) for r in sorted(rows)] == want and all(r["p"] == r["q"] for r in rows)


def test_binning_rules(spark):
    """An exact inner edge goes up; 0.1, 0.5 and 1.0 under the three rules for ten bins."""
    edges = F.lit([0.0, 1.0, 2.0, 4.0])
    rows = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.5, 1.0, 1.5, 2.0, 3.9, 4.0, 9.0)], "x double").select(T.bin_of(F.col("x"), edges)).collect()
    assert [r[0] for r in rows] == [0, 0, 0, 1, 1, 2, 2, 2, 2]
    got = [tuple(r) for r in spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.5, 1.0)], "s double").select(T.floor_bin(F.col("s")), T.right_closed_bin(F.col("s"))).collect()]
    assert got == [(0, 0), (1, 0), (5, 4), (9, 9)]


def test_s_curve_rises(spark):
    s = [i / 50 for i in range(51)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in s], "s double").select(V.lsh_probability(F.col("s"), 4, 20)).collect()]
    assert got == sorted(got) and got[0] == 0 and got[-1] == 1
    assert V.lsh_shapes(64) == [(1, 64), (2, 32), (4, 16), (8, 8), (16, 4), (32, 2), (64, 1)]


def plain_simhash(tokens):
    if not tokens:
        return -1
    h = [int(hashlib.md5(t.encode()).hexdigest()[:16], 16) for t in tokens]
    word = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) >= len(h))
    return word - (1 << 64) if word >> 63 else word


def plain_fnv(tokens):
    def fnv(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = ((h ^ b) * 0x100000001B3) % (1 << 64)
        return h

    votes = [0] * 64
    for t, n in Counter(tokens).items():
        for i in range(64):
            votes[i] += n if fnv(t.encode()) >> (63 - i) & 1 else -1
    return "".join("1" if v > 0 else "0" for v in votes)


def test_signatures(spark):
    lists = [[], ["a"], ["a", "b"], ["a", "a", "b", "é"], ["x"] * 5 + ["y"] * 4]
    df = spark.createDataFrame([(t,) for t in lists], "t array<string>")
    rows = df.select(S.simhash_md5("t"), S.simhash_fnv("t"), S.minhash(F.col("t"), 4)).collect()
    for t, (m, f, mh) in zip(lists, rows, strict=True):
        assert m == plain_simhash(t) and f == plain_fnv(t)
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % S.PRIME for x in t]
        assert mh == [min(((x * a + b) % S.PRIME for x in h), default=-1) for a, b in S.minhash_parameters(4)]


def test_sequence_ratio(spark):
    a, b = "abc " * 80, "abd " * 75 + "xyz"
    assert one(spark, "a string, b string", (a, b), T.sequence_ratio("a", "b"))[0] == pytest.approx(difflib.SequenceMatcher(None, a, b).ratio())
