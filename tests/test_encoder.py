"""The encoder: gradients, data-parallel steps against a plain loop, codes."""

import numpy as np
import pytest

from dupsift.operators import encoder, lsh, scan
from dupsift.plans import encoded


def pairs_of(n=60, dims=5, seed=0):
    rng = np.random.default_rng(seed)
    x1, x2 = rng.standard_normal((n, dims)), rng.standard_normal((n, dims))
    x2[::2] = x1[::2] + 0.1 * x2[::2]
    return x1, x2, np.where(np.arange(n) % 2, 0.0, 1.0)


@pytest.mark.parametrize("kind", ["mse", "contrastive", "baseline"])
def test_gradient_is_that_of_the_loss(kind):
    """Against differences of the loss of the whole batch, and summed over shares of it."""
    model, o = encoder.Encoder.new([5, 7, 8], 1), encoder.Objective(4, 2, kind)
    x1, x2, y = pairs_of(20)
    x2[3] = x1[3] + 1.0

    def loss(flat):
        layers = model.shaped(flat)
        return encoder.gradient(layers, x1, x2, y, encoder.statistics(layers, x1, x2), o)[0]

    sums = encoder.statistics(model.layers, x1, x2)
    whole = encoder.gradient(model.layers, x1, x2, y, sums, o)
    flat = model.flat()
    for i in np.random.default_rng(2).choice(len(flat), 40, replace=False):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert (loss(flat + step) - loss(flat - step)) / 2e-6 == pytest.approx(whole[1][i], abs=1e-6)
    halves = [encoder.gradient(model.layers, x1[s], x2[s], y[s], sums, o) for s in (slice(0, 7), slice(7, 20))]
    assert halves[0][0] + halves[1][0] == pytest.approx(whole[0]) and halves[0][1] + halves[1][1] == pytest.approx(whole[1])


@pytest.mark.parametrize("kind", ["mse", "contrastive", "baseline"])
def test_training_equals_a_plain_loop(spark, kind):
    x1, x2, y = pairs_of()
    df = spark.createDataFrame([(i, i + 100, a.tolist(), b.tolist(), float(t)) for i, (a, b, t) in enumerate(zip(x1, x2, y, strict=True))], "id_1 bigint, id_2 bigint, v_1 array<double>, v_2 array<double>, y double").repartition(5)
    model, plain, o = encoder.Encoder.new([5, 6, 8]), encoder.Encoder.new([5, 6, 8]), encoder.Objective(4, 2, kind)
    losses = encoder.train(df, model, o, epochs=6, rate=0.02, warmup=3 if kind == "contrastive" else 0)
    want = []
    for epoch in range(6):
        own = encoder.Objective(4, 2, kind, quantization=o.quantization * min(1, epoch / 3))
        loss, g = encoder.gradient(plain.layers, x1, x2, y, encoder.statistics(plain.layers, x1, x2), own)
        want.append(loss)
        plain.adam(g, 0.02)
    assert losses == pytest.approx(want) and model.flat() == pytest.approx(plain.flat()) and losses[-1] < losses[0]
    two = encoder.train(df, model, o, epochs=1, batches=3)
    assert len(two) == 1 and two[0] < losses[0]
    with pytest.raises(ValueError):
        encoder.train(df.limit(0), model, o)


def test_codes(spark):
    model = encoder.Encoder.new([3, 4, 70])
    rows = [(i, "a", [float(i), 1.0, -2.0]) for i in range(5)] + [(9, "b", None)]
    got = {r["id"]: r for r in encoder.encode(spark.createDataFrame(rows, "id bigint, label string, v array<double>").repartition(2), model).collect()}
    assert got[9]["words"] is None and got[9]["label"] == "b"
    for i in range(5):
        e = encoder.outputs(model.layers, np.array([[float(i), 1.0, -2.0]]))[-1][0]
        assert got[i]["e"] == pytest.approx(e.tolist())
        bits = "".join("1" if x > 0 else "0" for x in e).ljust(128, "0")
        assert [w % (1 << 64) for w in got[i]["words"]] == [int(bits[:64], 2), int(bits[64:], 2)]
    with pytest.raises(ValueError):
        encoder.Encoder.new([100_000, 1_000])


@pytest.mark.parametrize("twice", [False, True])
def test_top_k_by_vectors_made_in_tasks(spark, monkeypatch, twice):
    """As with the vectors in the table; crowded codes, rare ones, nulls, also where an id repeats."""
    monkeypatch.setattr(scan, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(3)
    model = encoder.Encoder.new([3, 8, 64], 4)
    x = rng.standard_normal((300, 3)) * np.where(np.arange(300) % 3, 0.05, 2.0)[:, None] + np.where(np.arange(300) % 3, 1.0, 0.0)[:, None]
    rows = [(i, None if i == 31 else "ab"[i % 2], None if i == 40 else v, None if i == 41 else 0) for i, v in enumerate(x.tolist())]
    if twice:
        rows.append(rows[50])
    df = spark.createDataFrame(rows, "id bigint, label string, v array<double>, z int").repartition(3)
    codes = encoder.encode(df, model, keep=("label", "v", "z")).selectExpr("id", "label", "v", "e", "IF(z IS NULL, NULL, words[0]) AS word").cache()
    own = codes.groupBy("word").count()
    assert own.where("count > 5").count() and own.where("count < 4").count()
    plain = codes.selectExpr("id", "label", "e AS v", "word")
    short = codes.select("id", "label", "v", "word")
    for same in (True, False):
        want = sorted(map(repr, lsh.top_k(plain, plain.where("id % 10 < 2"), 4, 4, 16, same).collect()))
        got = lsh.top_k(short, short.where("id % 10 < 2"), 4, 4, 16, same, vectors=encoder.last_outputs(spark, model), crowded=True)
        assert sorted(map(repr, got.collect())) == want


def test_encoder_topk_moves_features(spark, monkeypatch):
    """Not the outputs, 64 numbers a row."""
    seen, plain = [], encoded.lsh.top_k

    def top_k(coded, *args, **more):
        seen.append(coded.selectExpr("max(size(v)) AS n").first()["n"])
        return plain(coded, *args, **more)

    monkeypatch.setattr(encoded.lsh, "top_k", top_k)
    encoded.encoder_topk(spark, "/root/testdata/sf0.001")
    assert seen == [4]
