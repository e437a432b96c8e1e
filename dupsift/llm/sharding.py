"""Sharding by sampled splitters.

Records are ordered by (hash of the text, doc_id). Keys are drawn with a probability in proportion to the record's size, and
quantiles of the draws become splitters that cut this order into ranges of nearly equal bytes. A range that turns out overfull
is drawn from again, more densely, and subdivided; a text that fills whole ranges (a large group of copies) is cut by
doc_id. Ranges are cut further into cells, each small enough to be sorted in one task; a cell that turns out overfull all the same (a group of
copies has one key) is dealt into more by a hash, and its records are ordered by that first. Exact sums over ranges and cells give every
record its place in the whole order, and that place in bytes gives the shard, so shards differ by less than one record from equal bytes: the splitters
make the ranges, the exact sums correct their inequality.

Only DataFrame operations run on the executors. What comes to the driver is bounded: about DRAWS keys for each range and round, and a few sums for each range. Equal
rows are counted before they are exchanged and travel as chunks, which are drawn, dealt and ordered as one record each and unfolded at the end, so no number of them makes a large task.
Null text has no bytes; texts of any length count whole, by their size and hashes; a null doc_id sorts last. Repeated rows are records of their own, each with its slot. An empty
table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

#: Ranges for each shard, expected draws for each range, rounds of subdivision, records for each cell.
RANGES_A_SHARD, DRAWS, ROUNDS, CELL_ROWS = 8, 16, 3, 20_000
BROADCAST_ROWS = 500_000
LAST_ID = (1 << 63) - 1
#: A range is overfull beyond so many times its share.
OVERFULL = 2.0


def _range_of(splitters: list[tuple[int, int]]):
    """The number of splitters at or before the row's (key, id)."""
    if not splitters:
        return F.lit(0)
    keys, ids = F.lit([k for k, _ in splitters]).cast("array<bigint>"), F.lit([i for _, i in splitters]).cast("array<bigint>")
    before = lambda i: (F.get(keys, i) < F.col("key")) | ((F.get(keys, i) == F.col("key")) & (F.get(ids, i) <= F.col("id")))
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(len(splitters) - 1)), before))


def _quantiles(drawn: list[tuple[int, int, float]], pieces: int) -> list[tuple[int, int]]:
    """Boundaries that cut the weighted draws (key, id, weight) into so many pieces."""
    total, so_far, out = sum(w for *_, w in drawn), 0.0, []
    for key, id_, w in sorted(drawn):
        if so_far and so_far >= total * (len(out) + 1) / pieces:
            out.append((key, id_))
            while so_far >= total * (len(out) + 1) / pieces and len(out) < pieces - 1:
                out.append((key, id_))
        so_far += w
    return out[: pieces - 1]


def _isolate(splitters: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """In order; a key that holds two or more splitters gets ranges of its own."""
    keys: dict[int, int] = {}
    for k, _ in splitters:
        keys[k] = keys.get(k, 0) + 1
    for k, n in keys.items():
        if n > 1:
            splitters |= {(k, -LAST_ID - 1)} | ({(k + 1, -LAST_ID - 1)} if k < LAST_ID else set())
    return sorted(splitters)


def splitters_of(records: DataFrame, total: int, shards: int) -> list[tuple[int, int]]:
    """Splitters (key, id) for records with key, id, chunk, size, whose sizes sum to total. Rows are drawn by a hash of all but the size."""
    ranges = shards * RANGES_A_SHARD

    def draw(rows: DataFrame, each: float, seed: int) -> list:
        chance = F.least(F.lit(1.0), F.col("size") / each)
        u = F.pmod(F.xxhash64("key", "id", "chunk", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        return [(r[0], r[1], max(float(r[2]), each)) for r in rows.where(u < chance).select("key", "id", "size").collect()]

    found = set(_quantiles(draw(records, total / (ranges * DRAWS), 0), ranges))
    for seed in range(1, ROUNDS + 1):
        cuts = _isolate(set(found))
        placed = records.withColumn("range", _range_of(cuts))
        full = placed.groupBy("range").agg(F.sum("size").alias("b")).where(F.col("b") > OVERFULL * total / ranges).collect()
        if not full:
            break
        dense = placed.where(F.col("range").isin([r["range"] for r in full])).select("key", "id", "chunk", "size", "range")
        each = total / (ranges * DRAWS * 4)
        chance = F.least(F.lit(1.0), F.col("size") / each)
        u = F.pmod(F.xxhash64("key", "id", "chunk", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        drawn: dict[int, list] = {}
        for r in dense.where(u < chance).collect():
            drawn.setdefault(r["range"], []).append((r["key"], r["id"], max(float(r["size"]), each)))
        more = set()
        for r in full:
            more |= set(_quantiles(drawn.get(r["range"], []), 1 + int(r["b"] * ranges / total)))
        if more <= found:
            break  # one key of one id: nothing left to cut
        found |= more
    return _isolate(set(found))


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null: the law isn't 'key')."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.coalesce("doc_id", F.lit(LAST_ID)).cast("bigint").alias("id"),
    )
    # Equal rows as chunks of at most CELL_ROWS, each one record until the end.
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CELL_ROWS))))
    chunks = counted.withColumn("n", F.least(F.lit(CELL_ROWS), F.col("n") - F.col("chunk") * CELL_ROWS)).withColumn("weight", F.col("size") * F.col("n"))
    records = materialize(chunks, "records")
    total = records.agg(F.sum("weight")).first()[0] or 1
    placed = records.withColumn("range", _range_of(splitters_of(records.select("key", "id", "chunk", F.col("weight").alias("size")), total, shards)))
    ranges = placed.groupBy("range").agg(
        F.sum("weight").alias("b"), F.sum("n").alias("n"), F.count("*").alias("records"), F.min("key").alias("k0"), F.max("key").alias("k1"), F.min("id").alias("i0"), F.max("id").alias("i1")
    ).collect()  # at most a few for each of shards * RANGES_A_SHARD
    # Where a range lies: bytes and rows before it, and how its cells are cut: by key, or by id where it has one key.
    ranges.sort(key=lambda r: r["range"])
    where, b, n = {}, 0, 0
    for r in ranges:
        one = r["k0"] == r["k1"]
        lo, hi = (r["i0"], r["i1"]) if one else (r["k0"], r["k1"])
        where[r["range"]] = (b, n, one, float(lo), max(float(hi) - float(lo), 1.0), 1 + r["records"] // CELL_ROWS)
        b, n = b + r["b"], n + r["n"]
    rows = [where.get(i, (0, 0, False, 0.0, 1.0, 1)) for i in range(max(where, default=0) + 1)]
    of_range = lambda i, kind: F.get(F.lit([r[i] for r in rows]).cast(f"array<{kind}>"), F.col("range"))
    value = F.when(of_range(2, "boolean"), F.col("id").cast("double")).otherwise(F.col("key").cast("double"))
    cells = of_range(5, "bigint")
    placed = placed.withColumn("cell", F.least(F.floor((value - of_range(3, "double")) / of_range(4, "double") * cells), cells - 1))
    full = placed.groupBy("range", "cell").agg(F.count("*").alias("n")).where(F.col("n") > 2 * CELL_ROWS)
    full = materialize(full.select("range", "cell", F.ceil(F.col("n") / CELL_ROWS).alias("parts")), "full")
    placed = placed.join(broadcast_if_small(full, full.count(), BROADCAST_ROWS), ["range", "cell"], "left")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("key", "id", "chunk"), F.coalesce("parts", F.lit(1))))
    by_range = Window.partitionBy("range").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("range", "cell", "part")
        .agg(F.sum("weight").alias("cell_b"), F.sum("n").alias("cell_n"))
        .select(
            "range",
            "cell",
            "part",
            (F.coalesce(F.sum("cell_b").over(by_range), F.lit(0)) + of_range(0, "bigint")).alias("b0"),
            (F.coalesce(F.sum("cell_n").over(by_range), F.lit(0)) + of_range(1, "bigint")).alias("n0"),
        )
    )
    in_cell = Window.partitionBy("range", "cell", "part").orderBy("key", "id", "size", "chunk")
    earlier = in_cell.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("weight").over(earlier), F.lit(0)) + F.col("b0")
    place = F.coalesce(F.sum("n").over(earlier), F.lit(0)) + F.col("n0")
    ordered = materialize(
        placed.join(starts, ["range", "cell", "part"])
        .select("doc_id", "size", "text_crc32", "n", before.alias("bytes_before"), place.alias("place"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("copy"))
        .withColumn("bytes_before", F.col("bytes_before") + F.col("copy") * F.col("size"))
        .select("doc_id", "size", "text_crc32", F.least(F.lit(shards - 1), F.floor(F.col("bytes_before") * shards / F.lit(total))).cast("int").alias("shard"), (F.col("place") + F.col("copy")).alias("place")),
        "ordered",
    )
    first = {r["shard"]: r["p"] for r in ordered.groupBy("shard").agg(F.min("place").alias("p")).collect()}
    offset = F.get(F.lit([first.get(s, 0) for s in range(shards)]).cast("array<bigint>"), F.col("shard"))
    return ordered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - offset).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
