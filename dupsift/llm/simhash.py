"""Near-duplicate documents by SimHash fingerprints and pivot distance tables.

Documents with one fingerprint are collapsed first. Every distinct fingerprint gets its Hamming distances to PIVOTS fixed reference
fingerprints, packed into two integers. By the triangle inequality two fingerprints within `bits` differ by at most `bits` in every
coordinate, so a pair whose largest coordinate difference is greater is discarded without looking at the fingerprints; survivors are verified
exactly. Which pairs are looked at: with two differing bits, at least two of four 16-bit blocks are equal, so equal blocks make an
exact equi-join key (six keys of 32 bits). A crowded key isn't paired: its fingerprints are each spread to their 64 one-bit neighbours
and themselves, and those that meet at one of these points, at most 65, are linked to the least of them. Two fingerprints
within two bits always meet so, hence no link is lost and no group makes its square in pairs.

Near copies with a Jaccard similarity of 0.8 mostly differ in more bits than any exact key can bridge. With `similar`, texts whose sets of
SHINGLE-word shingles have at least that Jaccard similarity are linked too, exactly: in any one order of all shingles, two such sets share one
among the first n - ceil(similar n) + 1 of each, so these prefixes are the join keys. Shingles that crowd the prefixes come last in the order, found by a first pass.
A pair is only looked at where, if the key is the first that both have, enough shingles follow it in both. Each text is first compared with the smallest one of its FIRST_KEYS most frequent keys, which joins groups of near copies at few
pairs a text. Of each key that then has several components the texts are compared with the smallest of them only; where that makes
all of a key's texts one component, the key is done, so a group of near copies makes a few pairs for each, not its square. In the keys left the next smallest texts
(eight times as many each time, up to MOST_LEADERS) are compared with the others, and texts that no remaining one can be similar to leave, until one component or one text is left,
or at most four pairs for each key of a text at the start: then those are compared.
Every text has a sketch, its shingles' number on each of about four bits a shingle, modulo two; sets whose sketches differ in more bits than similar sets can in shingles are dropped, exactly. Of many pairs that are left, each text's
NEAREST are verified on the whole sets first, then those of the others whose texts aren't of one component by then.

Null text has no words; its fingerprint is zero. Repeated rows share a component. A null doc_id never names a component unless all ids of the
component are null. An empty table gives an empty one, and texts of any length are read whole. Extra columns, whatever their names, are dropped by `near_duplicates` and kept by `keep_first`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop_table, fresh_name, materialize, spare, without
from .components import components

BITS, BLOCKS, PIVOTS, SEED = 2, 4, 16, 42
#: A key with more fingerprints goes the other way.
CROWDED = 16
BROADCAST_ROWS = 500_000
#: Words of a shingle for Jaccard similarity; a prefix shingle of more texts is moved to the end of the order, of at most HOT such.
SHINGLE, COMMON, HOT, MOST_LEADERS, FIRST_KEYS, NEAREST, FEW_PAIRS = 5, 30, 200_000, 1024, 3, 2, 20_000
_CHUNK = 1 << 16


def shingles(text: str | None, words: int) -> np.ndarray:
    """Hashes of a text's word shingles, in its order; a shorter text is one shingle."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(words, len(parts))
    n = len(parts) - k + 1
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    return np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n)


def fingerprint(text: str | None, words: int = 3) -> int:
    """Of one text: a bit is set if it is set in over half of the hashes of its word shingles."""
    hashes = shingles(text, words)
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        counts += np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, h (a hash of the text) and fp (the 64 bits as a signed integer) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in spare(batches):
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), b.column(2), pa.array(fps, pa.int64())], names=["doc_id", "h", "fp"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id bigint, h bigint, fp bigint")


def _pivots() -> list[int]:
    """Reference fingerprints made by a rule: hashes of 0, 1, ..., as signed integers."""
    return [int(np.uint64(xxhash.xxh64_intdigest(str(i), SEED)).view(np.int64)) for i in range(PIVOTS)]


def _table(fp: Column, pivots: list[int]) -> Column:
    """Eight distances in one integer, eight bits each."""
    out = F.lit(0).cast("bigint")
    for i, p in enumerate(pivots):
        out = out.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("bigint"), 8 * i))
    return out


def _far(a: str, b: str, bits: int) -> Column:
    """Some coordinate of two distance tables differs by more than bits."""
    at = lambda c, i: F.shiftright(F.col(c), 8 * i).bitwiseAND(F.lit(127))
    return F.greatest(*(F.abs(at(f"{a}.pivots{k}", i) - at(f"{b}.pivots{k}", i)) for k in range(PIVOTS // 8) for i in range(8))) > bits


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) over the column fp of distinct fingerprints that have the components of all links within BITS."""
    pivots = _pivots()
    block = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(65535))
    keys = [
        F.shiftleft(F.lit(16 * i + j).cast("bigint"), 32).bitwiseOR(F.shiftleft(block(i), 16)).bitwiseOR(block(j)) for i in range(BLOCKS) for j in range(i + 1, BLOCKS)
    ]
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    counted = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    entries = materialize(keyed.join(counted, "key"), "entries")
    tables = [_table(F.col("fp"), pivots[8 * k : 8 * k + 8]).alias(f"pivots{k}") for k in range(PIVOTS // 8)]
    sparse = entries.where(F.col("n") <= CROWDED).select("key", "fp", *tables)
    a, b = sparse.alias("a"), sparse.alias("b")
    survives = ~_far("a", "b", BITS) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= BITS)
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & survives).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    crowded = entries.where(F.col("n") > CROWDED).select("fp").distinct()
    near = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(int(np.uint64(1 << i).view(np.int64)))) for i in range(64))]
    spread = crowded.select("fp", F.explode(F.array(*near)).alias("point"))
    met = spread.groupBy("point").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)  # 65 at most
    return pairs.union(met.select(F.explode("all").alias("a"), "b").where("a <> b"))


def _prefix(own: np.ndarray, hot: np.ndarray, similar: float) -> np.ndarray:
    """The keys of a set of shingles, hot (sorted) ones last."""
    n = len(own)
    common = hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own if len(hot) else np.zeros(n, bool)
    length = n - math.ceil(similar * n - 1e-9) + 1 if n else 0
    return np.concatenate([own[~common], own[common]])[:length]


def _sketch(own: np.ndarray) -> bytes:
    """How many shingles fall on each bit, modulo two. Sets whose sketches differ in d bits differ in d shingles at least."""
    bits = max(256, 1 << (2 * len(own)).bit_length())
    counts = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(counts & 1, bitorder="little").tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """A lower bound of the number of shingles that one of two sets has alone, by their sketches; the longer one is folded to the other's length."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _key_counts(texts: DataFrame, similar: float) -> DataFrame:
    """key, n: in how many texts a shingle is a key, before any is known as hot. Counted in each block first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in spare(batches):
            keys = [_prefix(np.unique(shingles(t.as_py(), SHINGLE)), np.zeros(0, np.uint64), similar) for t in b.column(0)]
            key, n = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.uint64), return_counts=True)
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    return texts.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _prefixes(texts: DataFrame, similar: float, hot: np.ndarray) -> DataFrame:
    """h, size (of the shingle set), key and its place pos for each key of a row, with the set's sketch beside the first; hot shingles come last in the order."""
    last = texts.sparkSession.sparkContext.broadcast(np.sort(hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in spare(batches):
            for at in range(0, b.num_rows, 64):
                part, keys, sizes, sketches = b.slice(at, 64), [], [], []
                for t in part.column(1):
                    own = np.unique(shingles(t.as_py(), SHINGLE))
                    keys.append(_prefix(own, last.value, similar))
                    sizes.append(len(own))
                    sketches += [_sketch(own), *[None] * (len(keys[-1]) - 1)] if len(own) else []
                taken = np.array([len(k) for k in keys])
                h, key = np.repeat(part.column(0).to_numpy(zero_copy_only=False), taken), np.concatenate(keys).view(np.int64)
                pos = np.arange(len(key)) - np.repeat(np.cumsum(taken) - taken, taken)
                columns = [pa.array(c.astype(np.int64)) for c in (h, np.repeat(sizes, taken), key, pos)]
                yield pa.record_batch([*columns, pa.array(sketches, pa.binary())], names=["h", "size", "key", "pos", "sketch"])

    return texts.mapInArrow(run, "h bigint, size bigint, key bigint, pos bigint, sketch binary")


def _verified(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Those of the pairs (a, b) of text hashes whose whole shingle sets are similar."""
    needed = materialize(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "needed")
    chosen = texts.join(broadcast_if_small(needed, needed.count(), BROADCAST_ROWS), "h", "left_semi")
    chosen = materialize(chosen.dropDuplicates(["h"]), "texts")
    drop_table(pairs.sparkSession, needed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}  # of the last few texts: pairs with one text come together
        for b in spare(batches):
            keep = []
            for a, c, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                for h, t in ((a, x), (c, y)):
                    if h not in sets:
                        if len(sets) >= 64:
                            sets.pop(next(iter(sets)))
                        sets[h] = np.unique(shingles(t.as_py(), SHINGLE))
                one, two = sets.get(a), sets[c]
                one = np.unique(shingles(x.as_py(), SHINGLE)) if one is None else one
                shared = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(shared >= similar * (len(one) + len(two) - shared) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(chosen.select(F.col("h").alias("b"), F.col("text").alias("y")), "b").join(chosen.select(F.col("h").alias("a"), F.col("text").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def similar_links(docs: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) of hashes of texts whose shingle sets have a Jaccard similarity of at least similar: enough of them for the components of all such pairs."""
    texts = docs.select(F.xxhash64("text").alias("h"), "text").where("text IS NOT NULL")
    counted = _key_counts(texts, similar)
    spark = docs.sparkSession
    # Written first: its batches of texts are then as small as any table's.
    frequent = materialize(counted.where(F.col("n") > COMMON).orderBy(F.desc("n"), "key").limit(HOT).select("key"), "hot")
    hot = frequent.toArrow().column(0).to_numpy()  # only their order depends on it
    drop_table(spark, frequent)
    keyed = materialize(_prefixes(texts, similar, hot.view(np.uint64)), "prefixes")
    # One exchange by the key serves distinct, count and join.
    by_key = keyed.select("key", "h", "size", "pos").repartition("key").distinct()
    entries = materialize(by_key.join(by_key.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key").select("key", "h", "size", "pos", "n"), "shared")
    sketches = keyed.where("pos = 0").select("h", "size", "sketch").join(entries.select("h").distinct(), "h", "left_semi")
    sketches = materialize(sketches.dropDuplicates(["h"]), "sketches")
    drop_table(spark, keyed)
    share = similar / (1 + similar)  # of two sizes together that must be in both sets

    def possible(a: str, b: str) -> Column:
        """Enough shingles follow the key in both texts."""
        after = F.least(*(F.col(f"{x}size") - F.col(f"{x}pos") for x in (a, b)))
        return after >= F.ceil((F.col(f"{a}size") + F.col(f"{b}size")) * share - 1e-9)

    def close(pairs: DataFrame) -> DataFrame:
        """The pairs whose sketches don't rule them out, with what the sketches tell."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in spare(batches):
                sizes = b.column(2).to_numpy() + b.column(3).to_numpy()
                apart = np.array([_apart(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)], np.int64)
                near = apart <= sizes - 2 * np.ceil(sizes * share - 1e-9)
                yield pa.record_batch([b.column(0).filter(near), b.column(1).filter(near), pa.array(apart[near] / sizes[near])], names=["a", "b", "apart"])

        side = lambda c: sketches.select(F.col("h").alias(c), F.col("size").alias(f"{c}_size"), F.col("sketch").alias(f"{c}_sketch"))
        both = pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_size", "b_size", "a_sketch", "b_sketch")
        return materialize(both.mapInArrow(run, "a bigint, b bigint, apart double"), "close")

    def tested(pairs: DataFrame, links: DataFrame | None) -> DataFrame:
        """links and similar ones of the pairs, enough for the same components. Each text's NEAREST pairs are verified first; those whose texts are then of one component needn't be."""
        left, nearest = close(pairs), NEAREST
        while many := left.count():
            if many <= FEW_PAIRS:  # cheaper to verify than to tell which needn't be
                found = materialize(_verified(left.select("a", "b"), texts, similar), "verified", 64)
                new = materialize(found if links is None else links.union(found), "links")
                for t in (left, found, *([] if links is None else [links])):
                    drop_table(spark, t)
                return new
            ranked = left
            for c in ("a", "b"):
                ranked = ranked.withColumn(f"{c}_rank", F.row_number().over(Window.partitionBy(c).orderBy("apart", "a", "b")))
            ranked = materialize(ranked, "ranked")
            first = F.least("a_rank", "b_rank") <= nearest
            found = materialize(_verified(ranked.where(first).select("a", "b"), texts, similar), "verified", 64)  # two texts in a row
            new = materialize(found if links is None else links.union(found), "links")
            roots = components(new)
            root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: E731, B023
            apart = ~F.coalesce("a_root", "a").eqNullSafe(F.coalesce("b_root", "b"))
            rest = ranked.where(~first).select("a", "b", "apart").join(root("a"), "a", "left").join(root("b"), "b", "left").where(apart)
            rest = materialize(rest.select("a", "b", "apart"), "left")
            for t in (left, ranked, found, *([] if links is None else [links])):
                drop_table(spark, t)
            left, links, nearest = rest, new, 4 * nearest
        drop_table(spark, left)
        return links if links is not None else materialize(left.select("a", "b").limit(0), "links")

    def leaders(rows: DataFrame, n: int) -> DataFrame:
        """The n smallest texts of each key."""
        best = Window.partitionBy("key").orderBy("size", "h")
        return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).select("key", *(F.col(c).alias(f"l_{c}") for c in ("h", "size", "pos", "class")))

    def star(rows: DataFrame, first: DataFrame) -> DataFrame:
        pairs = rows.join(first, "key").where((F.col("h") != F.col("l_h")) & (F.col("class") != F.col("l_class")) & possible("", "l_"))
        return pairs.select(F.least("l_h", "h").alias("a"), F.greatest("l_h", "h").alias("b"))

    def still_open(rows: DataFrame, first: DataFrame | None, links: DataFrame) -> DataFrame:
        """rows without the leaders, which have been compared with all others of their keys, without texts too large for what follows the key in
        the smallest one left, and only of keys with texts of several components."""
        roots = components(links).withColumnRenamed("node", "h")
        if first is not None:
            rows = rows.join(first.select("key", F.col("l_h").alias("h")), ["key", "h"], "left_anti")
        rows = rows.drop("class").join(roots, "h", "left").withColumn("class", F.coalesce("root", "h")).drop("root")
        rows = materialize(rows, "rows")
        most = F.floor((F.col("size") - F.col("pos")) / share + 1e-9) - F.col("size")  # the largest partner
        rest = rows.join(rows.groupBy("key").agg(F.min("size").alias("smallest")), "key").where(most >= F.col("smallest")).drop("smallest")
        keys = rest.groupBy("key").agg(F.min("class").alias("c0"), F.max("class").alias("c1")).where("c0 < c1").select("key")
        still = materialize(rest.join(keys, "key"), "open")
        drop_table(spark, rows)
        return still

    # Each text is first compared with the leaders of its few most common keys: that joins large groups of near copies, whose other keys are then of one class.
    rows = entries.withColumn("class", F.col("h"))
    common = Window.partitionBy("h").orderBy(F.desc("n"), "key")
    few = materialize(rows.withColumn("rank", F.row_number().over(common)).where(F.col("rank") <= FIRST_KEYS).drop("rank"), "few")
    links = tested(star(few, leaders(few, 1)), None)
    drop_table(spark, few)
    rows, most, take = still_open(rows, None, links), entries.count(), 1
    drop_table(spark, entries)

    def all_pairs(rows: DataFrame) -> DataFrame:
        a, b = (rows.select("key", *(F.col(c).alias(f"{x}{c}") for c in ("h", "size", "pos", "class"))) for x in ("a_", "b_"))
        pairs = a.join(b, "key").where((F.col("a_h") < F.col("b_h")) & (F.col("a_class") != F.col("b_class")) & possible("a_", "b_"))
        return pairs.select(F.col("a_h").alias("a"), F.col("b_h").alias("b"))

    while left := rows.groupBy("key").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0]:
        if left <= 4 * most:
            return tested(all_pairs(rows), links)
        first = materialize(leaders(rows, take), "leaders")
        links = tested(star(rows, first), links)
        rest = still_open(rows, first, links)
        for t in (rows, first):
            drop_table(spark, t)
        rows, take = rest, min(8 * take, MOST_LEADERS)
    return links


def near_duplicates(docs: DataFrame, words: int = 3, similar: float | None = None) -> DataFrame:
    """doc_id, h, fp, component_id (the least doc_id reachable over links; with similar, also over links of similar texts) for each row."""
    own = materialize(fingerprints(docs, words), "fingerprints")
    distinct = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    edges = links(distinct)
    if similar is not None:
        of_text = own.select("h", "fp").distinct()
        pairs = similar_links(docs, similar)
        pairs = pairs.join(of_text.select(F.col("h").alias("a"), F.col("fp").alias("x")), "a").join(of_text.select(F.col("h").alias("b"), F.col("fp").alias("y")), "b")
        edges = edges.union(pairs.select("x", "y"))
    roots = materialize(components(edges).join(distinct, F.col("node") == F.col("fp")).select("fp", "root", "least"), "roots")
    merged = roots.join(roots.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component")
    named = distinct.join(merged, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return own.join(named, "fp").select("doc_id", "h", "fp", "component_id")


def keep_first(docs: DataFrame, words: int = 3, similar: float | None = None) -> DataFrame:
    """docs with one document of each component: that of the least doc_id (then of the least text hash). Columns as they are. The documents
    to drop are broadcast up to BROADCAST_ROWS counted rows; beyond that the join shuffles."""
    classes = materialize(near_duplicates(docs, words, similar).groupBy("doc_id", "h", "component_id").agg(F.count("*").alias("n")), "classes")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "h")
    first = classes.groupBy("component_id").agg(F.min(order).alias("first"), F.count("*").alias("texts"), F.max("n").alias("rows"))
    many = first.where("texts > 1").select(F.col("component_id").alias("c"), "first")
    dropped = classes.join(many, F.col("component_id").eqNullSafe(F.col("c"))).where(order != F.col("first")).select("doc_id", "h")
    kept = without(docs, materialize(dropped, "dropped"), BROADCAST_ROWS)
    if first.where("rows > 1").limit(1).count():  # rows repeated with their id
        name = fresh_name(kept)
        kept = kept.withColumn(name, F.xxhash64("text")).dropDuplicates(["doc_id", name]).drop(name)
    return kept


def simhash_digests(docs: DataFrame) -> DataFrame:
    """What op9 returns."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
