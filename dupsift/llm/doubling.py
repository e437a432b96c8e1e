"""Exact deduplication of word passages by level-wise doubling.

A word is removed if a window of LENGTH consecutive words that covers it also starts anywhere else, in the same document or another; windows
are judged on the input. Words are maximal runs of bytes other than ASCII white space. Windows are compared level by level:

1. Texts that occur more than once are found by their hashes. All their windows repeat, so they are resolved without being compared; one of each
   goes on, marked, for the sake of the others. The texts are dealt into blocks of about BLOCK_BYTES.
2. First level (9 words for LENGTH = 35): a block hashes the windows at every word and sends each distinct hash once to a bucket, with a
   mark if it is met twice within the block. A bucket answers with a bit for each: met elsewhere or not.
3. A window of twice the length (or of LENGTH, where that is less) is a candidate if both windows of the length before, at its beginning and its end, repeat. Only candidates
   and the words under them go on, and are compared in the same way by two 64-bit hashes. Texts without candidates are finished.
4. So on, beyond LENGTH too, until no candidates survive. The windows that repeat at LENGTH mark the words to remove; the largest level
   at which a text has one is its `longest`.

A block sends one row to a bucket and gets one back, however often a passage occurs in it, so a hot passage costs one entry a block. Every level is
a written table. The first level may take two windows for equal whose 32 compared bits agree; such a candidate dies at the next level.

Null text counts as empty; empty texts and an empty table are fine; texts of any length are read whole, in slices. doc_id plays no part: a null one is like any
other, and repeated rows are copies of each other, of which all lose their windows. Extra columns, whatever their names, are dropped by `removals` and kept by `strip`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, materialize
from .suffix_dedup import _bytes_of, _numbers

LENGTH = 35
#: The first level is the least of LENGTH's halves with at least so many words.
FIRST_WORDS = 8
#: Bytes of text in a block, in a slice of it that is hashed at once, and for each bucket.
BLOCK_BYTES, SLICE_BYTES, SHARE_BYTES = 8 << 20, 1 << 20, 64 << 20
#: Texts that occur more than once and are broadcast.
BROADCAST_ROWS = 500_000
#: Kinds of rows: a finished row, a text that waits, a block's candidates, a packet for a bucket, marked windows, texts that reach a level.
DONE, TEXT, STATE, PACKET, MARKS, REACHED = range(6)
LEVEL = T.StructType([T.StructField(n, k()) for n, k in [("kind", T.IntegerType), *[(n, T.LongType) for n in ("block", "bucket", "level")], *[(n, T.BinaryType) for n in "abc"]]])
_U = np.uint64
_TABLE = np.random.default_rng(13).integers(0, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
_BYTE, _WORD = 0x9E3779B97F4A7C15, (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)


def levels(length: int) -> Iterator[int]:
    """Lengths of the windows, each at most twice the one before; `length` is one of them. Without end."""
    down = [length]
    while down[-1] // 2 >= FIRST_WORDS:
        down.append(-(-down[-1] // 2))
    yield from reversed(down)
    while True:
        length *= 2
        yield length


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0x9E3779B97F4A7C15)
    return h ^ (h >> _U(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


def _sums(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of values times the powers of an odd base, and the inverse powers: from these come the hashes of all stretches."""
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * _powers(base, len(values)), dtype=_U, out=sums[1:])
    return sums, _powers(pow(base, -1, 1 << 64), len(values))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts one after the other: a 64-bit hash of each word, and where the words of each text begin among them."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    inside = (data != 0x20) & ((data < 9) | (data > 13))
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[edges] = inside[edges]
    ends[:-1] &= ~inside[1:]
    ends[edges - 1] = inside[edges - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    del inside, begins, ends
    out, at = np.empty(len(starts), _U), 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(stops, starts[at] + SLICE_BYTES, "right")))
        low = starts[at]
        sums, inverse = _sums(_TABLE[data[low : stops[end - 1]]], _BYTE)
        s, e = starts[at:end] - low, stops[at:end] - low
        out[at:end] = _mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(_U))
        at = end
    return out, np.searchsorted(starts, offsets)


def window_hashes(words: np.ndarray, at: np.ndarray, length: int, which: int) -> np.ndarray:
    """A 64-bit hash, one of two independent ones, of the `length` words at each of the given places."""
    sums, inverse = _sums(_mix(words + _U(which)), _WORD[which])
    return _mix((sums[at + length] - sums[at]) * inverse[at])


def _grouped(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by the columns, and for each row the number of its group of equal rows."""
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    new = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new)
    return order, group


class _Windows:
    """A block's windows of one length: the distinct ones as packets for buckets, and back from the buckets' bits to places."""

    def __init__(self, words: np.ndarray, at: np.ndarray, twice: np.ndarray, length: int, shares: int, wide: bool):
        h = window_hashes(words, at, length, 0)
        bucket = (h & _U(0xFFFFFFFF)) % _U(shares)
        if wide:
            keys = [bucket, h, window_hashes(words, at, length, 1)]
        else:
            keys = [(bucket << _U(32)) | (h >> _U(32))]
        order, self.group = _grouped(keys)
        first = order[np.flatnonzero(np.diff(self.group[order], prepend=-1))]
        n = np.bincount(self.group, minlength=len(first))
        self.more = (n > 1) | (np.bincount(self.group, twice, len(first)) > 0)
        self.bucket = bucket[first].astype(np.int64)
        self.payload = np.stack([k[first] for k in keys[1:]], axis=1) if wide else (keys[0][first] & _U(0xFFFFFFFF)).astype(np.uint32)

    def packets(self) -> list[tuple]:
        """(bucket, keys met once here, keys met twice)."""
        cut = np.flatnonzero(np.diff(self.bucket, prepend=-1)).tolist() + [len(self.bucket)]
        out = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            more, payload = self.more[a:b], self.payload[a:b]
            out.append((int(self.bucket[a]), payload[~more].tobytes(), payload[more].tobytes()))
        return out

    def repeated(self, answers: dict[int, bytes]) -> np.ndarray:
        """Which windows repeat. answers: bits by bucket for the keys met once."""
        known = self.more.copy()
        once = np.flatnonzero(~self.more)
        cut = np.flatnonzero(np.diff(self.bucket[once], prepend=-1)).tolist() + [len(once)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            bits = np.unpackbits(np.frombuffer(answers[int(self.bucket[once[a]])], np.uint8), count=b - a)
            known[once[a:b]] = bits > 0
        return known[self.group]


def _answers_of_bucket(wide: bool) -> Callable[[pa.Table], pa.Table]:
    """For each packet the bits of its keys: met in another packet too, or twice in one."""

    def run(rows: pa.Table) -> pa.Table:
        once, more = ([np.frombuffer(x, "<u8" if wide else "<u4").reshape(-1, 2 if wide else 1) for x in rows.column(c).to_pylist()] for c in ("a", "b"))
        keys = np.concatenate(once + more)
        _, group = _grouped(list(keys.T))
        sizes, n_once = [len(x) for x in once], sum(map(len, once))
        found = np.bincount(group) > 1
        found[group[n_once:]] = True
        bits = found[group[:n_once]]
        ends = np.cumsum(sizes)
        packed = [np.packbits(bits[e - s : e]).tobytes() for s, e in zip(sizes, ends.tolist(), strict=True)]
        some = np.array(sizes) > 0
        blocks, buckets = (np.array(rows.column(c).to_pylist(), np.int64)[some] for c in ("block", "bucket"))
        return _table([(PACKET, int(b), int(k), None, None, None, p) for b, k, p in zip(blocks, buckets, [p for p, s in zip(packed, some, strict=True) if s], strict=True)])

    return run


def _table(rows: list[tuple], more: dict[str, pa.Array] | None = None) -> pa.Table:
    """Rows of LEVEL; `more`: further columns, of the same length."""
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    columns = {f.name: pa.array([r[i] for r in rows], kinds[i]) for i, f in enumerate(LEVEL)}
    return pa.table(columns | (more or {}))


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of True."""
    change = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    return change[::2], change[1::2]


def _covered(n: int, at: np.ndarray, length: int) -> np.ndarray:
    """Which of n places the windows at the given ones cover."""
    change = np.zeros(n + 1, np.int64)
    change[at] += 1  # places are distinct
    np.add.at(change, at + length, -1)
    return np.cumsum(change[:-1]) > 0


class _State:
    """A block's candidates: stretches (text, first word, number of words, whether the text is a repeated one), the words' hashes, which words begin a candidate."""

    def __init__(self, stretches: np.ndarray, words: np.ndarray, live: np.ndarray):
        self.stretches, self.words, self.live = stretches, words, live

    @classmethod
    def unpack(cls, a: bytes, b: bytes, c: bytes) -> _State:
        words = np.frombuffer(b, "<u8")
        return cls(np.frombuffer(a, "<i8").reshape(-1, 4), words, np.unpackbits(np.frombuffer(c, np.uint8), count=len(words)) > 0)

    def rows(self, block: int, length: int, shares: int) -> list[tuple]:
        """The state and its packets as rows; none without candidates."""
        if not self.live.any():
            return []
        out = [(STATE, block, None, length, self.stretches.astype("<i8").tobytes(), self.words.astype("<u8").tobytes(), np.packbits(self.live).tobytes())]
        return out + [(PACKET, block, k, length, once, more, None) for k, once, more in self.windows(length, shares).packets()]

    def windows(self, length: int, shares: int) -> _Windows:
        at = np.flatnonzero(self.live)
        return _Windows(self.words, at, np.repeat(self.stretches[:, 3], self.stretches[:, 2])[at], length, shares, wide=True)

    def grown(self, repeated: np.ndarray, old: int, new: int) -> _State:
        """The candidates of length `new`: both windows of length `old` at their ends repeat (repeated: a mask over words)."""
        sizes = self.stretches[:, 2]
        ends = np.repeat(np.cumsum(sizes), sizes)
        place, later = np.arange(len(self.words)), np.zeros(len(self.words), bool)
        later[: max(0, len(repeated) - (new - old))] = repeated[new - old :]
        live = repeated & later & (place + new <= ends)
        keep = _covered(len(self.words), np.flatnonzero(live), new)
        starts = np.cumsum(sizes) - sizes
        own = np.repeat(np.arange(len(sizes)), sizes)[keep]
        inside = (place - np.repeat(starts, sizes))[keep]
        cut = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(inside, prepend=-2) != 1))
        stretches = np.stack([self.stretches[own[cut], 0], self.stretches[own[cut], 1] + inside[cut], np.diff(np.r_[cut, len(own)]), self.stretches[own[cut], 3]], axis=1) if len(cut) else np.zeros((0, 4), np.int64)
        return _State(stretches, self.words[keep], live[keep])


def _of_texts(rows: pa.Table, length: int) -> _State:
    """All words of a block's texts as one state: each text with at least `length` words is a stretch, a window at each of its words."""
    data, offsets = _bytes_of(rows.column("text"))
    words, begins = word_hashes(data, offsets)
    sizes = np.diff(begins)
    (twice,) = _numbers(rows, "twice")
    fits = sizes >= length
    live = np.repeat(fits, sizes)
    return _State(np.stack([np.flatnonzero(fits), np.zeros(fits.sum(), np.int64), sizes[fits], twice[fits]], axis=1), words[live], live[live])


def _first_windows(state: _State, first: int, shares: int) -> tuple[_Windows, np.ndarray]:
    sizes = state.stretches[:, 2]
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.flatnonzero(np.arange(len(state.words)) + first <= ends)
    return _Windows(state.words, at, np.repeat(state.stretches[:, 3], sizes)[at], first, shares, wide=False), at


def _hashes_of_block(length: int, shares: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        block, state = rows.column("block")[0].as_py(), _of_texts(rows, length)
        if not len(state.words):
            return _table([])
        first = next(levels(length))
        return _table([(PACKET, block, k, first, once, more, None) for k, once, more in _first_windows(state, first, shares)[0].packets()])

    return run


def _candidates_of_block(length: int, shares: int, finish: Callable, empty: dict[str, pa.Array]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Texts without candidates of the second level are finished; others wait, with the block's candidates beside them."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table([], empty)
        block, state = rows.column("block")[0].as_py(), _of_texts(rows, length)
        waiting = np.zeros(rows.num_rows, bool)
        more = []
        if len(state.words):
            series = levels(length)
            first, second = next(series), next(series)
            windows, at = _first_windows(state, first, shares)
            repeated = np.zeros(len(state.words), bool)
            repeated[at] = windows.repeated(dict(zip(answers.column("bucket").to_pylist(), answers.column("c").to_pylist(), strict=True)))
            del windows
            state = state.grown(repeated, first, second)
            waiting[state.stretches[:, 0]] = True
            more = state.rows(block, second, shares)
        twice = np.array(rows.column("twice").to_pylist(), bool)
        own = [(TEXT if w else DONE, block, i, None, None, None, None) for i, w in enumerate(waiting.tolist()) if not twice[i]]
        rows = rows.filter(pa.array(~twice))
        waiting = waiting[~twice]
        done = finish(rows.column("row"), [None if w else t.as_py().encode() for w, t in zip(waiting.tolist(), rows.column("text"), strict=True)], [None] * len(own), [0] * len(own))
        spare = pa.nulls(len(more))
        columns = {"out": done, "row": rows.column("row"), "text": pa.array([t.as_py() if w else None for w, t in zip(waiting.tolist(), rows.column("text"), strict=True)], pa.string())}
        return _table(own + more, {k: pa.chunked_array([*(v.chunks if isinstance(v, pa.ChunkedArray) else [v]), spare.cast(v.type)]) for k, v in columns.items()})

    return run


def _level_of_block(length: int, level: int, new: int, shares: int) -> Callable[[pa.Table], pa.Table]:
    """The candidates of one level with the buckets' answers become marks and the candidates of the next."""

    def run(rows: pa.Table) -> pa.Table:
        table, state, answers = rows.to_pylist(), None, {}
        for r in table:
            if r["kind"] == STATE:
                state = _State.unpack(r["a"], r["b"], r["c"])
            else:
                answers[r["bucket"]] = r["c"]
        block = table[0]["block"]
        repeated = np.zeros(len(state.words), bool)
        repeated[np.flatnonzero(state.live)] = state.windows(level, shares).repeated(answers)
        out = []
        if level >= length:
            s = state.stretches
            own = np.repeat(np.arange(len(s)), s[:, 2])
            reached = np.unique(s[own[repeated], 0])
            if len(reached):
                out.append((REACHED, block, None, level, reached.astype("<i8").tobytes(), None, None))
        if level == length:
            begins = np.flatnonzero(repeated)
            starts = np.cumsum(s[:, 2]) - s[:, 2]
            marks = np.stack([s[own[begins], 0], s[own[begins], 1] + begins - starts[own[begins]]], axis=1)
            out.append((MARKS, block, None, level, marks.astype("<i8").tobytes(), None, None))
        return _table(out + state.grown(repeated, level, new).rows(block, new, shares))

    return run


def _finish_block(length: int, finish: Callable) -> Callable[[pa.Table], pa.Table]:
    """The texts of a block that waited, with the marks of all levels."""

    def run(rows: pa.Table) -> pa.Table:
        kinds = np.array(rows.column("kind").to_pylist())
        longest: dict[int, int] = {}
        marks = np.zeros((0, 2), np.int64)
        for r in rows.select(["kind", "level", "a"]).filter(pa.array(kinds != TEXT)).to_pylist():
            if r["kind"] == MARKS:
                marks = np.frombuffer(r["a"], "<i8").reshape(-1, 2)
            else:
                for i in np.frombuffer(r["a"], "<i8").tolist():
                    longest[i] = max(longest.get(i, 0), r["level"])
        marks = marks[np.argsort(marks[:, 0], kind="stable")]
        texts = rows.filter(pa.array(kinds == TEXT))
        numbers = texts.column("bucket").to_pylist()
        low, high = np.searchsorted(marks[:, 0], numbers, "left"), np.searchsorted(marks[:, 0], numbers, "right")
        spans = [marks[a:b, 1] if a < b else None for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        out = finish(texts.column("row"), [t.as_py().encode() for t in texts.column("text")], spans, [longest.get(i, 0) for i in numbers])
        return pa.table({"out": out})

    return run


def kept_words(text: bytes, starts: np.ndarray | bool | None, length: int) -> tuple[list[bytes], int]:
    """The words that remain, and how many there were. starts: where repeated windows begin, or True if all windows repeat."""
    words = text.split()
    if starts is None or starts is True and len(words) < length:
        return words, len(words)
    if starts is True:
        return [], len(words)
    gone = _covered(len(words), np.unique(starts), length)
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], len(words)


def _resolve(docs: DataFrame, text_col: str, length: int, result: Callable, schema: T.StructType) -> DataFrame:
    """schema's rows, made by result(rows of all columns of docs but the text, texts as bytes, starts of repeated windows as in kept_words, longest)."""
    spark, text = docs.sparkSession, F.col(f"`{text_col}`")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col))
    keyed = docs.select(F.xxhash64(text).alias("h"), F.md5(text).alias("m"), text.alias("text"), row.alias("row"))
    row_type = keyed.schema["row"].dataType
    out_kind, row_kind = _arrow(schema), _arrow(row_type)

    def finish(rows: pa.ChunkedArray, texts: list[bytes | None], starts: list, longest: list[int]) -> pa.Array:
        """The rows as structs; null where the text is None."""
        table = result(rows, [t or b"" for t in texts], starts, longest)
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns]
        return pa.StructArray.from_arrays(columns, fields=list(out_kind), mask=pa.array([t is None for t in texts], pa.bool_()))

    fits = F.octet_length("text") >= 2 * length - 1
    groups = materialize(keyed.where(fits).groupBy("h", "m").agg(F.count("*").alias("n"), F.first(F.octet_length("text")).alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    copies = groups.where("n > 1").select("h", "m")
    copies = broadcast_if_small(copies, copies.count(), BROADCAST_ROWS)
    blocks = max(1, -(-total // BLOCK_BYTES))
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARE_BYTES))
    single = keyed.where(fits).join(copies, ["h", "m"], "left_anti").select("h", "text", "row", F.lit(False).alias("twice"))
    copied = keyed.where(fits).join(copies, ["h", "m"], "left_semi")
    once = copied.groupBy("h", "m").agg(F.first("text").alias("text")).select("h", "text", F.lit(None).cast(row_type).alias("row"), F.lit(True).alias("twice"))
    grouped = single.union(once).withColumn("block", F.pmod("h", F.lit(blocks))).drop("h").groupBy("block")
    first = grouped.applyInArrow(_hashes_of_block(length, shares), LEVEL).groupBy("bucket").applyInArrow(_answers_of_bucket(False), LEVEL)
    empty = {"out": pa.array([], out_kind), "row": pa.array([], row_kind), "text": pa.array([], pa.string())}
    wide = T.StructType([*LEVEL, T.StructField("out", schema), T.StructField("row", row_type), T.StructField("text", T.StringType())])
    base = materialize(grouped.cogroup(first.groupBy("block")).applyInArrow(_candidates_of_block(length, shares, finish, empty), wide), "level0")

    series = levels(length)
    next(series)
    level, table, marks = next(series), base.select(*LEVEL.names), []
    while table.where(F.col("kind") == PACKET).limit(1).count():
        new = next(series)
        answers = table.where(F.col("kind") == PACKET).groupBy("bucket").applyInArrow(_answers_of_bucket(True), LEVEL)
        state = table.where(F.col("kind") == STATE).union(answers)
        table = materialize(state.groupBy("block").applyInArrow(_level_of_block(length, level, new, shares), LEVEL), f"level{level}")
        if level >= length:
            marks.append(table.where(F.col("kind").isin(MARKS, REACHED)))
        level = new

    none = [F.lit(None).cast(row_type).alias("row"), F.lit(None).cast("string").alias("text")]
    waiting = base.where(F.col("kind") == TEXT).select(*LEVEL.names, "row", "text")
    for m in marks:
        waiting = waiting.union(m.select(*LEVEL.names, *none))
    out_type = T.StructType([T.StructField("out", schema)])
    rest = waiting.groupBy("block").applyInArrow(_finish_block(length, finish), out_type)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py().encode() if t.is_valid else b"" for t in b.column(1)]
            twice = b.column(2).to_pylist()
            tops = [_longest(len(t.split()), length) if c else 0 for t, c in zip(texts, twice, strict=True)]
            yield from pa.table({"out": finish(pa.chunked_array([b.column(0)]), texts, [True if c else None for c in twice], tops)}).to_batches()

    short = keyed.where(~F.coalesce(fits, F.lit(False))).select("row", "text", F.lit(False).alias("twice"))
    others = short.union(copied.select("row", "text", F.lit(True).alias("twice"))).mapInArrow(untouched, out_type)
    return base.where(F.col("kind") == DONE).select("out").union(rest).union(others).select("out.*")


def _longest(n: int, length: int) -> int:
    """The largest level that a text of n words has a window of, from `length` on."""
    return 0 if n < length else length << ((n // length).bit_length() - 1)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind, prefers_large_types=False)


def removals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """What op13 returns: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space); and longest, the largest level at which a window repeats, or 0."""
    schema = T.StructType.fromDDL("doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, longest bigint")

    def digests(rows: pa.ChunkedArray, texts: list[bytes], starts: list, longest: list[int]) -> pa.Table:
        found = []
        for t, own, top in zip(texts, starts, longest, strict=True):
            kept, n = kept_words(t, own, length)
            found.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), top))
        columns = [pa.array([r[i] for r in found], k) for i, k in enumerate([pa.int64(), pa.int64(), pa.string(), pa.int64()])]
        return pa.table([_fields(rows)[0], *columns], names=schema.names)

    return _resolve(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "text", length, digests, schema)


def strip(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with the repeated passages taken out of their texts: what is left is joined by one space. Texts without such passages stay as they are, and
    so do other columns."""
    names, schema = docs.columns, docs.schema

    def stripped(rows: pa.ChunkedArray, texts: list[bytes], starts: list, longest: list[int]) -> pa.Table:
        new = [(b" ".join(kept_words(t, own, length)[0]) if top else t).decode() for t, own, top in zip(texts, starts, longest, strict=True)]
        others = iter(_fields(rows))
        return pa.table([pa.array(new, pa.string()) if n == text_col else next(others) for n in names], names=[str(i) for i in range(len(names))])

    filled = _resolve(docs.where(F.col(f"`{text_col}`").isNotNull()), text_col, length, stripped, schema)
    return filled.union(docs.where(F.col(f"`{text_col}`").isNull()))


ORACLE_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i : i + {LENGTH - 1}], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - {LENGTH - 2})) AS i FROM d WHERE len(w) >= {LENGTH})),
hits AS (SELECT r, i FROM win SEMI JOIN (SELECT h FROM win GROUP BY h HAVING count(*) > 1) USING (h)),
gone AS (SELECT DISTINCT r, i + k AS i FROM hits, range(0, {LENGTH}) t(k)),
kept AS (SELECT r, list(x ORDER BY i) AS w FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(d.w) AS n_words, len(d.w) - coalesce(len(kept.w), 0) AS n_removed, sha256(coalesce(array_to_string(kept.w, ' '), '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""


def _fields(rows: pa.ChunkedArray) -> list[pa.Array]:
    """The columns of a column of structs."""
    return pa.concat_arrays(rows.chunks).flatten() if rows.num_chunks else pa.array([], rows.type).flatten()
