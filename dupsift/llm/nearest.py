"""Approximate nearest neighbours by inverted lists with an adaptive dimension scan.

Centroids are fitted on a bounded sample (FIT_ROWS vectors, chosen and ordered by hashes, so that results don't depend on how a table is cut); every vector is then
put into the list of its nearest centroid. A query probes its own list and those with the largest inner products with the query. Vectors are rotated by one random orthogonal matrix and held in column blocks of BLOCK dimensions. Within a list the
scan adds up partial squared distances block by block; after each block a hypothesis test asks whether a candidate can still have an inner
product above the query's present k-th best: by the rotation, the partial distance over d of D dimensions estimates the whole one with a
relative error of about 1/sqrt(d), so candidates whose estimate exceeds their bound by more than EPSILON/sqrt(d) are abandoned. The k-th
best of a query is known from the start at least as its k-th best in the sample, which every part begins with. Survivors
are scored by the exact inner product of the original vectors, in double precision, summed in the order of the dimensions: equal vectors have equal scores.

Lists are cut into parts of at most PART vectors and queries into groups of at most GROUP, so that a list which holds a third of all
vectors is scanned by many tasks. Each part gives at most k candidates a query, which one window merges.

Vectors that are null, zero, or hold null or non-finite components take no part. Vectors of different lengths have no inner product: each length is
searched by itself. Equal scores go to the smaller vec_id. Repeated rows are
candidates each; a query's own rows (its id) never are. Extra columns, whatever their names, are dropped. An empty table or no valid vector: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

FIT_ROWS, ROUNDS, SEED = 20_000, 8, 42
#: Bytes of the sample that go to every executor, for the first thresholds.
FLOOR_BYTES = 16 << 20
#: There are sqrt(vectors) / LISTS lists, MOST_LISTS at most. A query probes as many as give RECALL over CALIBRATED queries of the sample and WORST for each of them.
LISTS, MOST_LISTS, RECALL, WORST, CALIBRATED = 4, 4096, 0.96, 0.8, 400
PART, GROUP, BLOCK, EPSILON = 4096, 512, 16, 1.2


def valid(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """vec_id, v (array of double) of the vectors that take part."""
    v = F.transform(col, lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("v", lambda x: x != 0.0)
    return vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL").where(~bad & some)


def fit(points: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of the sample by Lloyd's iterations."""
    rng = np.random.default_rng(SEED)
    centers = points[rng.choice(len(points), min(lists, len(points)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = assign(points, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(centers))
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def assign(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers**2).sum(1) - 2 * points @ centers.T, axis=1)


def promising(queries: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """For each query all lists, the most promising first: its own list, where its copies are, then by inner product with the centroid."""
    scores = queries @ centers.T
    scores[np.arange(len(queries)), assign(queries, centers)] = np.inf
    return np.argsort(-scores, axis=1, kind="stable")


def probes(points: np.ndarray, centers: np.ndarray, k: int) -> int:
    """How many lists to probe, so that RECALL of the k nearest in the sample, by brute force, lie in them, and for each single query at least WORST of its
    own. The sample's neighbours are farther off than those among all vectors, so this errs on the side of more lists."""
    step = max(1, len(points) // CALIBRATED)
    own = points[::step]
    near, place = assign(points, centers), np.argsort(promising(own, centers), axis=1)
    scores = own @ points.T
    scores[np.arange(len(own)), np.arange(len(points))[::step]] = -np.inf
    top = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, max(1, len(points) - 1))]
    needed = np.sort(np.take_along_axis(place, near[top], axis=1), axis=1)
    worst = needed[:, int(np.ceil(WORST * needed.shape[1])) - 1].max()
    return 1 + max(int(worst), int(np.quantile(needed, RECALL, method="higher")))


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def inner(points: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed in the order of the dimensions, so that a row's sum doesn't depend on its place."""
    return np.add.accumulate(points * q, axis=1)[:, -1] if points.size else np.zeros(len(points))


def floors(queries: np.ndarray, query_ids: np.ndarray, sample: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th best inner product of each query in the sample: no more than that among all vectors."""
    if len(sample) <= k:
        return np.full(len(queries), -np.inf)
    out = np.empty(len(queries))
    for at in range(0, len(queries), 256):
        scores = queries[at : at + 256] @ sample.T
        scores[query_ids[at : at + 256, None] == ids[None, :]] = -np.inf
        out[at : at + 256] = np.partition(scores, len(sample) - k, axis=1)[:, len(sample) - k]
    return out


def scan(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, turn: np.ndarray, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Per query at most k candidates of this part: (query number, id, score), and the share of dimensions that was looked at."""
    dims = points.shape[1]
    q_turned, p_turned = queries @ turn, points @ turn
    columns = [np.ascontiguousarray(p_turned[:, a : a + BLOCK]) for a in range(0, dims, BLOCK)]
    norms = (points**2).sum(1)
    # Squared distances over a block as |c|^2 + |q|^2 - 2 c q; those over the first block at once for all queries.
    squares = [(c**2).sum(1) for c in columns]
    q_squares = np.stack([(q_turned[:, a : a + BLOCK] ** 2).sum(1) for a in range(0, dims, BLOCK)], axis=1)
    start_of = squares[0] + q_squares[:, :1] - 2 * (q_turned[:, :BLOCK] @ columns[0].T) if len(points) > 4 * k else None
    out, looked, most = [], 0, 4 * k
    for i, q in enumerate(queries):
        qq = float(q @ q)
        alive = np.arange(len(points))
        tau = -np.inf if floor is None else floor[i]
        if len(points) > most:
            partial = start_of[i]
            for j, c in enumerate(columns):
                looked += len(alive) * c.shape[1]
                if j:
                    partial = partial + (squares[j][alive] + q_squares[i, j] - 2 * (c[alive] @ q_turned[i, j * BLOCK : j * BLOCK + c.shape[1]]))
                d = min(dims, j * BLOCK + c.shape[1])
                if j == 0:  # those that look best now may raise the threshold
                    first = np.argpartition(partial * (dims / d) - norms, most)[:most]
                    start = points[first] @ q
                    start[ids[first] == query_ids[i]] = -np.inf
                    sure = first[np.argpartition(start, most - k)[most - k :]]  # stay whatever the thresholds, so that k are found
                    tau = max(tau, np.partition(start, most - k)[most - k])
                    bound = np.maximum(norms + qq - 2 * tau, 0)  # squared distance at which the inner product is tau
                factor = 1.0 if d == dims else (1 + EPSILON / np.sqrt(d)) ** 2
                keep = partial * (dims / d) <= bound[alive] * factor * (1 + 1e-9) + 1e-9 * (qq + norms[alive])
                alive, partial = alive[keep], partial[keep]
            alive = np.union1d(alive, sure)
        alive = alive[ids[alive] != query_ids[i]]
        if len(alive) > k:  # near enough to the k-th best for rounding to decide
            rough = points[alive] @ q
            alive = alive[rough >= np.partition(rough, len(alive) - k)[len(alive) - k] - 1e-9 * (qq + norms[alive])]
        score = inner(points[alive], q)
        best = np.lexsort((ids[alive], -score))[:k]
        out.append((np.full(len(best), i), ids[alive][best], score[best]))
    n, found, scores = (np.concatenate(x) for x in zip(*out, strict=True))
    return n, found, scores, looked / max(1, len(queries) * points.size)


RESULT = "query_id bigint, rank int, vec_id bigint, score double"


def search(vectors: DataFrame, k: int = 20, is_query=None, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row (by default ids divisible by 20) its k nearest by inner product."""
    own = materialize(valid(vectors, id_col, col), "vectors")
    sizes = own.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy("dims").collect()  # a row for each length
    out = vectors.sparkSession.createDataFrame([], RESULT)
    for r in sizes:
        found = _search(own if len(sizes) == 1 else own.where(F.size("v") == r["dims"]), r["n"], k, is_query)
        out = found if len(sizes) == 1 else out.union(found)
    return out


def _search(own: DataFrame, n: int, k: int, is_query) -> DataFrame:
    """search over n vectors of one length."""
    spark = own.sparkSession
    share = min(1.0, 1.2 * FIT_ROWS / max(n, 1))
    chosen = own if share == 1.0 else own.where(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    order = [F.xxhash64(F.lit(SEED + 1), "vec_id", "v"), "vec_id", "v"]  # the same rows, in the same order, however the table is cut
    sample = chosen.orderBy(*order).limit(FIT_ROWS).collect()
    if not sample:  # so few ids, repeated so often, that none fell into the sample
        sample = own.orderBy(*order).limit(FIT_ROWS).collect()
    points, ids = np.array([r["v"] for r in sample], np.float64), np.array([r["vec_id"] for r in sample], np.int64)
    lists = int(np.clip(round(n**0.5 / LISTS), 1, MOST_LISTS))
    centers = fit(points, lists)  # MOST_LISTS rows at most
    probed = probes(points, centers, k)
    few = slice(0, max(1, FLOOR_BYTES // points[0].nbytes))
    model = spark.sparkContext.broadcast((centers, rotation(points.shape[1]), points[few], ids[few]))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(assign(x, model.value[0]) if len(x) else [], pa.int64())], names=["vec_id", "v", "list"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, _, some, some_ids = model.value
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column(1).to_pylist(), np.float64)
            near = promising(x, centers)[:, :probed]
            low = floors(x, b.column(0).to_numpy(), some, some_ids, k)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(low), pa.array([list(map(int, r)) for r in near], pa.list_(pa.int64()))], names=["query_id", "q", "floor", "lists"])

    listed = materialize(own.mapInArrow(put, "vec_id bigint, v array<double>, list bigint"), "lists")
    sizes = listed.groupBy("list").agg(F.count("*").alias("n"))  # a row for each list
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / PART)).cast("int")
    placed = listed.join(F.broadcast(sizes.select("list", parts.alias("parts"))), "list").withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int"))
    queries = own.where((F.col("vec_id") % 20 == 0) if is_query is None else is_query).select("vec_id", "v")
    asked = queries.mapInArrow(probe, "query_id bigint, q array<double>, floor double, lists array<bigint>").select("query_id", "q", "floor", F.explode("lists").alias("list"))
    n_queries = asked.groupBy("list").agg(F.count("*").alias("m")).select("list", F.greatest(F.lit(1), F.ceil(F.col("m") / GROUP)).cast("int").alias("groups"))
    groups = F.broadcast(n_queries)
    # Every part of a list meets every group of its queries.
    asked = asked.join(groups, "list").withColumn("group", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int"))
    asked = asked.join(F.broadcast(sizes.select("list", parts.alias("parts"))), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.join(groups, "list").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))

    def scanned(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        left, right = left.sort_values("query_id"), right.sort_values("vec_id")
        q, p = np.stack(left["q"].to_numpy()), np.stack(right["v"].to_numpy())
        i, ids, scores, _ = scan(q, left["query_id"].to_numpy(), p, right["vec_id"].to_numpy(), k, model.value[1], left["floor"].to_numpy())
        return pd.DataFrame({"query_id": left["query_id"].to_numpy()[i], "vec_id": ids, "score": scores})

    found = asked.select("list", "part", "group", "query_id", "q", "floor").groupBy("list", "part", "group").cogroup(placed.select("list", "part", "group", "vec_id", "v").groupBy("list", "part", "group"))
    found = found.applyInPandas(scanned, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
