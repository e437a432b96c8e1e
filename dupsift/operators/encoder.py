"""A hashing encoder trained on pairs of rows, data-parallel, and batched inference of codes.

The encoder is a stack of dense layers (ReLU, the last one tanh), shared by both rows of a pair. Three objectives: `mse` fits the soft block-Hamming similarity of the two
outputs to the pair's target, beside energy and balance terms of the batch; `contrastive` pulls equal pairs together and pushes others apart to a margin, with balance and quantisation terms;
`baseline` fits the Manhattan similarity and draws the outputs' absolute values together.

A step reads its batch twice, as the objectives hold means over the batch: first for these means, then for gradients. Weights are broadcast; every partition sums the
gradient of its pairs in numpy, sums are added in groups of about the square root of the partitions' number before they come to the driver, which holds one model and
takes an Adam step. So what moves for a step is a few models, whatever the number of pairs. A model has a bounded number of weights (MOST_WEIGHTS).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import kept
from .clean import md5_order

MOST_WEIGHTS = 50_000_000


@dataclass
class Objective:
    """kind: mse, contrastive or baseline. blocks, width: the output's blocks. Weights of the terms; margin of unequal pairs."""

    blocks: int
    width: int
    kind: str = "mse"
    margin: float = 0.7
    similarity: float = 15 / 16
    energy: float = 1 / 64
    balance: float = 0.1
    quantization: float = 0.01


@dataclass
class Encoder:
    """Weights and biases of the layers, and Adam's moments of them."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    steps: int = 0
    moments: list = field(default_factory=list)

    @classmethod
    def new(cls, dims: list[int], seed: int = 42) -> Encoder:
        """Glorot-uniform weights. dims: the input's size, hidden sizes, the output's size."""
        if sum(a * b + b for a, b in zip(dims, dims[1:], strict=False)) > MOST_WEIGHTS:
            raise ValueError(f"more than {MOST_WEIGHTS} weights")
        rng = np.random.default_rng(seed)
        return cls([(rng.uniform(-1, 1, (a, b)) * math.sqrt(6 / (a + b)), np.zeros(b)) for a, b in zip(dims, dims[1:], strict=False)])

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for layer in self.layers for x in layer])

    def shaped(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for w, b in self.layers:
            out.append((flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size]))
            at += w.size + b.size
        return out

    def adam(self, gradient: np.ndarray, rate: float = 1e-3, first: float = 0.9, second: float = 0.999) -> None:
        if not self.moments:
            self.moments = [np.zeros_like(gradient), np.zeros_like(gradient)]
        self.steps += 1
        m, v = self.moments
        m += (1 - first) * (gradient - m)
        v += (1 - second) * (gradient**2 - v)
        step = rate * (m / (1 - first**self.steps)) / (np.sqrt(v / (1 - second**self.steps)) + 1e-7)
        self.layers = self.shaped(self.flat() - step)


def outputs(layers: list, x: np.ndarray) -> list[np.ndarray]:
    """The input and the outputs of all layers."""
    out = [x]
    for i, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(np.tanh(z) if i == len(layers) - 1 else np.maximum(z, 0))
    return out


def statistics(layers: list, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """Sums over pairs: of both outputs by bit, of each output's mean square, and the number of pairs."""
    e1, e2 = outputs(layers, x1)[-1], outputs(layers, x2)[-1]
    return np.r_[(e1 + e2).sum(0), (e1**2).mean(1).sum(), (e2**2).mean(1).sum(), len(x1)]


def gradient(layers: list, x1: np.ndarray, x2: np.ndarray, y: np.ndarray, sums: np.ndarray, o: Objective) -> tuple[float, np.ndarray]:
    """These pairs' share of the loss of their batch, and of its gradient. sums: the statistics of the whole batch."""
    n, bits = sums[-1], o.blocks * o.width
    a1, a2 = outputs(layers, x1), outputs(layers, x2)
    e1, e2 = a1[-1], a2[-1]
    gap = (e1 - e2).reshape(len(y), o.blocks, o.width)
    most = np.abs(gap).argmax(2)[..., None]
    s = 1 - np.abs(np.take_along_axis(gap, most, 2)).sum((1, 2)) / (2 * o.blocks)
    slope = np.zeros_like(gap)  # of s by e1; by e2 the opposite
    np.put_along_axis(slope, most, -np.sign(np.take_along_axis(gap, most, 2)) / (2 * o.blocks), 2)
    slope = slope.reshape(e1.shape)
    if o.kind == "mse":
        loss = o.similarity * ((s - y) ** 2).sum() / n
        by_s = o.similarity * 2 * (s - y) / n
        d1, d2 = by_s[:, None] * slope, -by_s[:, None] * slope
        for e, d, total in ((e1, d1, sums[-3]), (e2, d2, sums[-2])):
            off = total / n - 1
            loss += o.energy * (off**2 * len(y) / n + (e.mean(1) ** 2).sum() / n)
            d += o.energy * (2 * off * 2 * e / bits / n + (2 * e.mean(1) / bits / n)[:, None])
    elif o.kind == "baseline":
        s = np.exp(-0.005 * np.abs(e1 - e2).sum(1))
        loss = 0.5 * ((s - y) ** 2).sum() / n
        by_s = (s - y) / n
        d1 = (-0.005 * by_s * s)[:, None] * np.sign(e1 - e2)
        d2 = -d1
        for e, d in ((e1, d1), (e2, d2)):  # minus the cosine of the absolute values to the vector of ones
            size = np.maximum(np.sqrt((e**2).sum(1)), 1e-12)
            total = np.abs(e).sum(1)
            loss -= 0.25 * (total / (math.sqrt(bits) * size)).sum() / n
            d -= 0.25 / n / math.sqrt(bits) * (np.sign(e) / size[:, None] - (total / size**3)[:, None] * e)
    else:
        d = 1 - s
        near = np.maximum(0, o.margin - d)
        loss = 0.5 * (y * d**2 + (1 - y) * near**2).sum() / n
        by_s = (-y * d + (1 - y) * near) / n
        mean = sums[:bits] / (2 * n)
        loss += o.balance * (mean**2).mean() * len(y) / n
        d1, d2 = by_s[:, None] * slope, -by_s[:, None] * slope
        for e, d in ((e1, d1), (e2, d2)):
            loss += o.quantization * ((np.abs(e) - 1) ** 2).mean(1).sum() / (2 * n)
            d += o.balance * 2 * mean / bits / (2 * n) + o.quantization * 2 * (np.abs(e) - 1) * np.sign(e) / bits / (2 * n)
    grads = [[np.zeros_like(w), np.zeros_like(b)] for w, b in layers]
    for acts, d in ((a1, d1), (a2, d2)):
        d = d * (1 - acts[-1] ** 2)
        for i in range(len(layers) - 1, -1, -1):
            grads[i][0] += acts[i].T @ d
            grads[i][1] += d.sum(0)
            if i:
                d = (d @ layers[i][0].T) * (acts[i] > 0)
    return float(loss), np.concatenate([x.ravel() for g in grads for x in g])


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _summed(pairs: DataFrame, function) -> np.ndarray | None:
    """The sum over all partitions of the vectors that function makes of (x1, x2, y); None without pairs."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                one = function(_matrix(b.column(0)), _matrix(b.column(1)), b.column(2).to_numpy(zero_copy_only=False).astype(np.float64))
                total = one if total is None else total + one
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["sum"])

    def added(rows: pa.Table) -> pa.Table:
        return pa.table({"sum": pa.array([_add(rows.column("sum").to_pylist()).tobytes()], pa.binary())})

    parts = pairs.select("v_1", "v_2", "y").mapInArrow(sums, "sum binary").withColumn("_p", F.spark_partition_id())
    groups = max(1, math.isqrt(pairs.rdd.getNumPartitions()))
    rows = parts.withColumn("_p", F.col("_p") % groups).groupBy("_p").applyInArrow(lambda t: added(t.select(["sum"])), "sum binary").collect()  # a row for each group
    return _add([r["sum"] for r in rows]) if rows else None


def _add(parts: list[bytes]) -> np.ndarray:
    total = np.frombuffer(parts[0], np.float64).copy()
    for p in parts[1:]:
        total += np.frombuffer(p, np.float64)
    return total


def train(pairs: DataFrame, encoder: Encoder, objective: Objective, epochs: int = 10, batches: int = 1, rate: float = 1e-3, warmup: int = 0, seed: int = 42) -> list[float]:
    """Trains the encoder in place on pairs (id_1, id_2, v_1, v_2, y: target similarity, or 1 and 0 for the contrastive kind) and returns the mean loss of each epoch. A pair's batch is fixed by
    its MD5; each batch is a partition of the written table, so a step reads only its own. With warmup the quantisation term grows over so many epochs. No pairs: ValueError."""
    spark = pairs.sparkSession
    number = F.conv(F.substring(md5_order(f"{seed}|batch", "id_1", "id_2"), 1, 8), 16, 10).cast("bigint") % batches
    table = kept(pairs.select("id_1", "id_2", F.transform("v_1", lambda x: x.cast("double")).alias("v_1"), F.transform("v_2", lambda x: x.cast("double")).alias("v_2"), F.col("y").cast("double").alias("y"), number.cast("int").alias("batch")).repartition("batch", F.xxhash64("id_1", "id_2") % 64).sortWithinPartitions("batch"), "pairs")
    there = sorted(r["batch"] for r in table.select("batch").distinct().collect())  # a row for each batch
    if not there:
        raise ValueError("no pairs to train on")
    history = []
    for epoch in range(epochs):
        o = Objective(**vars(objective))
        if warmup:
            o.quantization *= min(1.0, epoch / warmup)
        losses = []
        for b in there:
            rows = table.where(F.col("batch") == b)
            layers = spark.sparkContext.broadcast(encoder.layers)
            sums = _summed(rows, lambda x1, x2, y, w=layers: statistics(w.value, x1, x2))
            done = _summed(rows, lambda x1, x2, y, w=layers, t=sums, o=o: np.r_[tuple(np.atleast_1d(x) for x in gradient(w.value, x1, x2, y, t, o))])
            layers.unpersist()
            losses.append(done[0])
            encoder.adam(done[1:], rate)
        history.append(float(np.mean(losses)))
    return history


def encode(rows: DataFrame, encoder: Encoder, id_col: str = "id", vector: str = "v", keep: tuple[str, ...] = ("label",), with_outputs: bool = True) -> DataFrame:
    """id, the kept columns, e (outputs; null unless asked) and words (their signs, 64 to a word, the first in the highest place) of every row; rows with a null vector get nulls."""
    layers = rows.sparkSession.sparkContext.broadcast(encoder.layers)
    columns = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(len(columns))
            some = v.is_valid().to_numpy(zero_copy_only=False)
            e, words = [None] * len(v), [None] * len(v)
            if some.any():
                out = outputs(layers.value, _matrix(v.drop_null()))[-1]
                bits = np.pad(out > 0, ((0, 0), (0, -out.shape[1] % 64)))
                packed = np.packbits(bits, axis=1).view(">u8").astype(np.int64)
                for i, w in zip(np.flatnonzero(some).tolist(), packed.tolist(), strict=True):
                    words[i] = w
                if with_outputs:
                    for i, x in zip(np.flatnonzero(some).tolist(), out.tolist(), strict=True):
                        e[i] = x
            yield pa.record_batch([*(b.column(i) for i in range(len(columns))), pa.array(e, pa.list_(pa.float64())), pa.array(words, pa.list_(pa.int64()))], names=[*columns, "e", "words"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    doubles = F.transform(vector, lambda x: x.cast("double"))
    return rows.select(*columns, doubles.alias("_v")).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", e array<double>, words array<bigint>")


def last_outputs(spark: SparkSession, encoder: Encoder) -> Callable[[np.ndarray], np.ndarray]:
    """The encoder as a function of a matrix of vectors, for use in tasks. Vectors of another length are cut or ended by zeros."""
    layers = spark.sparkContext.broadcast(encoder.layers)

    def made(x: np.ndarray) -> np.ndarray:
        dims = layers.value[0][0].shape[0]
        return outputs(layers.value, np.pad(x[:, :dims], ((0, 0), (0, max(0, dims - x.shape[1])))))[-1]

    return made
