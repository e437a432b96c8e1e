"""Exact substring deduplication with sharded suffix arrays.

A byte is removed if a LENGTH-byte string that covers it also starts in a document with a smaller doc_id; matches never cross
documents and are judged on the input. Steps:

1. Exact copies: of equal texts only that with the smallest doc_id goes on; the others are removed whole (if they have LENGTH bytes).
2. Anchors: in every LENGTH-byte string the GRAM-byte string with the least hash (the leftmost of equals) is its anchor. That
   depends on nothing but the string, so equal strings have equal anchors, about one for each 16 bytes of text. Texts are dealt into blocks
   of about BLOCK_BYTES; a block sends each anchor hash once to a bucket and is answered with one row: the hashes that occur in two documents.
3. Snippets: the bytes of all strings that share a shared anchor. A block numbers its distinct strings, keeps for itself where each number occurs
   (in runs), and sends its distinct snippets to shards, with the least and greatest doc_id that it has for each. Of an anchor with more than
   CROWDED places every string is a snippet of its own, dealt by its own hash, so no anchor makes a large shard.
4. Shards: equal snippets of all blocks are one class with the least doc_id. A shard is worked off in sets of SHARD_CLASSES classes, no
   anchor in two sets. The suffix array is made by Larsson-Sadakane refinement in numpy: suffixes are ranked by their first
   eight bytes, then groups that are still equal by the rank of what follows, doubling the depth until no two are equal. Common prefixes of
   neighbours in the array come from Kasai's algorithm, capped at LENGTH, on many stretches of the text side by side; they cut the array into
   groups of equal LENGTH-byte strings, each with its least doc_id. The sorted runs of one set are merged by binary search: each run's strings
   are looked up in the others. A shard answers each row with one row: runs of string numbers that have an earlier owner.
5. A block marks the bytes of strings with an owner of smaller doc_id; the texts lose them.

So every exchange but that of the texts has a row for each block and bucket or shard, never one for each place, and one entry of a hot passage for each block.

Null text counts as empty; empty texts and an empty table are fine, and texts of any length are read whole. A null doc_id counts as larger than all others. Rows with one
doc_id never remove from each other; each row gives a row. Repeated rows (one id and text) give equal ones; one of them stands for all in its block. Extra columns, whatever their names, are dropped by `removals` and kept by `strip`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

LENGTH, GRAM = 50, 20
WINDOW = LENGTH - GRAM + 1
#: Bytes of text in a block, and in a slice of it that is hashed at once.
BLOCK_BYTES, SLICE_BYTES = 8 << 20, 2 << 20
#: Bytes of text for each bucket or shard, classes of one set of a shard and of one run of a set.
SHARE_BYTES, SHARD_CLASSES, RUN_CLASSES = 64 << 20, 50_000, 10_000
#: Places beyond which an anchor's strings are dealt one by one; copies that are broadcast.
CROWDED, BROADCAST_ROWS = 5_000, 500_000
LAST_ID = (1 << 63) - 1
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _words(data: np.ndarray, size: int) -> np.ndarray:
    """The little-endian integer of `size` bytes at each place."""
    return np.ndarray((len(data) - size + 1,), f"<u{size}", buffer=data, strides=(1,))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each place."""
    n = len(data) - GRAM + 1
    h = _words(data, 8)[:n] * _C[0]
    h ^= h >> np.uint64(32)
    h += _words(data, 8)[8 : 8 + n] * _C[1]
    h ^= h >> np.uint64(29)
    h *= _C[2]
    h += _words(data, 4)[16 : 16 + n] * _C[3]
    h ^= h >> np.uint64(32)
    h *= _C[0]
    h ^= h >> np.uint64(31)
    return h


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """For texts one after the other: hash, text number, place of the anchor, first start and number of starts of the strings that it stands for
    (places from the text's beginning)."""
    sizes = np.diff(offsets)
    starts_of = np.maximum(sizes - LENGTH + 1, 0)
    if not starts_of.sum():
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64))
    h = gram_hashes(data)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    m = key
    for step in (1, 2, 4, 8):
        m = np.minimum(m[:-step], m[step:])
    m = np.minimum(m[: -(WINDOW - 16)], m[WINDOW - 16 :])
    text = np.repeat(np.arange(len(sizes)), starts_of)
    first = np.repeat(offsets[:-1] - (np.cumsum(starts_of) - starts_of), starts_of) + np.arange(len(text))
    anchor = (m[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    count = np.diff(np.r_[new, len(anchor)])
    text, anchor, first = text[new], anchor[new], first[new]
    return h[anchor], text, anchor - offsets[text], first - offsets[text], count


def string_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the LENGTH bytes at each of the given places."""
    out = np.full(len(at), _C[3])
    for step in range(0, LENGTH - 7, 8):
        out = (out ^ _words(data, 8)[at + step]) * _C[step // 8 % 3]
        out ^= out >> np.uint64(31)
    out = (out ^ _words(data, 8)[at + LENGTH - 8]) * _C[0]
    return out ^ (out >> np.uint64(29))


def _bytes_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts without nulls, one after the other, and where each begins."""
    parts = [c.cast(pa.large_binary()) for c in column.chunks if len(c)]
    data, sizes = [], []
    for c in parts:
        offsets = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
        data.append(np.frombuffer(c.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]])
        sizes.append(np.diff(offsets))
    if not parts:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return np.concatenate(data), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last text of slices of about SLICE_BYTES."""
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield at, end
        at = end


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy().astype(np.int64) for n in names]


def _joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    """The packed numbers of a binary column's rows, one after the other."""
    parts = [np.frombuffer(x, kind) for x in table.column(name).to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Where groups of equal keys begin."""
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)


def _has(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


KNOWN = 1 << 15
HASHES = "bucket bigint, block bigint, hashes binary, places binary"
SHARED = "block bigint, hashes binary, crowded binary"
#: Rows of a block: shard null for what it keeps itself (texts' ids and runs of string numbers), else snippets for the shard.
ENTRIES = "shard bigint, block bigint, ids binary, hs binary, runs binary, snippets binary, sizes binary, first binary, deal binary, least binary, most binary"
#: What a block gets back: runs (string number, length) and their owners.
OWNERS = "block bigint, ids binary, hs binary, runs binary, owners binary"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], pa.int64() if kind == "bigint" else pa.binary()) for i, (name, kind) in enumerate(fields)})


def _hashes_of_block(buckets: int):
    def run(texts: pa.Table) -> pa.Table:
        (ids,) = _numbers(texts, "id")
        data, offsets = _bytes_of(texts.column("text"))
        found = []
        for a, b in _slices(offsets):
            h, text, _, _, _ = anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            found.append((h, ids[text + a]))
        h, own = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(h, kind="stable")
        h, own = h[order], own[order]
        g = _groups(h)
        if not len(g):
            return _table(HASHES, [])
        many = np.minimum.reduceat(own, g) != np.maximum.reduceat(own, g)
        places = (np.minimum(np.diff(np.r_[g, len(h)]), KNOWN - 1) | np.where(many, KNOWN, 0)).astype("<u2")
        h = h[g]
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        block = texts.column("block")[0].as_py()
        return _table(HASHES, [(int(k), block, h[o].tobytes(), places[o].tobytes()) for k in np.flatnonzero(np.diff(cut)) for o in [order[cut[k] : cut[k + 1]]]])

    return run


def _shared_in_bucket(crowded: int):
    """Answers each row with one row: those of its hashes that occur in two documents, apart from those with more places than crowded."""

    def run(rows: pa.Table) -> pa.Table:
        h, places = _joined(rows, "hashes", "<u8"), _joined(rows, "places", "<u2").astype(np.int64)
        order = np.argsort(h, kind="stable")
        g = _groups(h[order])
        entries = np.diff(np.r_[g, len(h)])
        shared = (entries > 1) | np.logical_or.reduceat(places[order] >= KNOWN, g)
        busy = np.add.reduceat(places[order] % KNOWN, g) > crowded
        kind = np.empty(len(h), np.int8)
        kind[order] = np.repeat(np.where(shared, np.where(busy, 2, 1), 0), entries)
        out, at = [], 0
        for block, blob in zip(rows.column("block").to_pylist(), rows.column("hashes").to_pylist(), strict=True):
            own, k = h[at : at + len(blob) // 8], kind[at : at + len(blob) // 8]
            at += len(own)
            out.append((block, own[k == 1].tobytes(), own[k == 2].tobytes()))
        return _table(SHARED, out)

    return run


def _entries_of_block(shards: int):
    """The snippets of shared anchors for the shards, and the places of their strings for the block itself."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        usual, busy = np.sort(_joined(answers, "hashes", "<u8")), np.sort(_joined(answers, "crowded", "<u8"))
        if not len(usual) + len(busy):
            return _table(ENTRIES, [])
        ids, hs = _numbers(texts, "id", "h")
        data, offsets = _bytes_of(texts.column("text"))
        number: dict[bytes, int] = {}
        keys, cls, docs, starts, counts = [], [], [], [], []
        for a, b in _slices(offsets):
            part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            h, text, _, first, count = anchors(part, own)
            crowded = _has(busy, h)
            keep = _has(usual, h)
            # Of a crowded anchor each string is a snippet of its own.
            n = count[crowded]
            each = np.repeat(first[crowded] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            own_text = np.r_[text[keep], np.repeat(text[crowded], n)]
            start = np.r_[first[keep], each]
            count = np.r_[count[keep], np.ones(len(each), np.int64)]
            at = own[own_text] + start
            key = np.r_[h[keep], string_hashes(part, at[keep.sum() :])]
            raw, known = part.tobytes(), len(number)
            these = np.fromiter((number.setdefault(raw[x:y], len(number)) for x, y in zip(at.tolist(), (at + count + LENGTH - 1).tolist(), strict=True)), np.int64, len(at))
            new = np.full(len(number) - known, -1, np.int64)
            fresh = these >= known
            new[these[fresh] - known] = np.flatnonzero(fresh)
            keys.append(key[new])
            cls.append(these)
            docs.append(own_text + a)
            starts.append(start)
            counts.append(count)
        cls, docs, starts, counts = map(np.concatenate, (cls, docs, starts, counts))
        snippets = list(number)
        if not snippets:
            return _table(ENTRIES, [])
        key, size = np.concatenate(keys), np.fromiter(map(len, snippets), np.int64, len(snippets))
        strings = size - LENGTH + 1
        base = np.cumsum(strings) - strings  # the number of a snippet's first string
        least, most = np.full(len(snippets), LAST_ID, np.int64), np.full(len(snippets), -LAST_ID - 1, np.int64)
        np.minimum.at(least, cls, ids[docs])
        np.maximum.at(most, cls, ids[docs])
        # Runs: places in one text whose starts and numbers go up together.
        order = np.lexsort((starts, docs))
        docs, starts, counts, first = docs[order], starts[order], counts[order], base[cls[order]]
        new = np.r_[True, (docs[1:] != docs[:-1]) | (starts[1:] != starts[:-1] + counts[:-1]) | (first[1:] != first[:-1] + counts[:-1])]
        g = np.flatnonzero(new)
        runs = np.stack([docs[g], starts[g], first[g], np.add.reduceat(counts, g)], axis=1).astype("<i4")
        block = texts.column("block")[0].as_py()
        out = [(None, block, ids.tobytes(), hs.tobytes(), runs.tobytes(), *[None] * 6)]
        shard = (key % np.uint64(shards)).astype(np.int64)
        deal = (key // np.uint64(shards) % np.uint64(1 << 16)).astype("<u2")
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(shards + 1))
        for k in np.flatnonzero(np.diff(cut)):
            o = order[cut[k] : cut[k + 1]]
            packed = b"".join([snippets[i] for i in o.tolist()])
            out.append((int(k), block, None, None, None, packed, size[o].astype("u1").tobytes(), base[o].astype("<i4").tobytes(), deal[o].tobytes(), least[o].tobytes(), most[o].tobytes()))
        return _table(ENTRIES, out)

    return run


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """The order of all suffixes by their first `depth` bytes at least (zeros follow the end), by refinement of ranks: only suffixes of groups
    that are still equal are sorted again, by the rank of what follows the part already ordered."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = _words(padded, 8)[:n].byteswap()  # compares as bytes do
    order = np.argsort(word, kind="stable")
    new = np.r_[True, word[order][1:] != word[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's rank is its first place
    done = 8
    while done < depth:
        size = np.diff(np.r_[np.flatnonzero(new), n])
        open_ = np.flatnonzero(np.repeat(size > 1, size))
        if not len(open_):
            break
        s = order[open_]
        after = np.where(s + done < n, rank[np.minimum(s + done, n - 1)] + 1, 0)
        key = rank[s] * (n + 1) + after
        o = np.argsort(key, kind="stable")
        order[open_] = s[o]
        key = key[o]
        split = np.r_[True, key[1:] != key[:-1]]
        new[open_] |= split
        rank[order[open_]] = np.maximum.accumulate(np.where(new, np.arange(n), 0))[open_]
        done *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, cap: int, lanes: int = 4096) -> np.ndarray:
    """Of each suffix in the order with the one before it, up to cap, by Kasai's algorithm: in text order, each height is at least that of the
    place before less one, and is extended from there. `lanes` stretches of the text go side by side; each extension compares eight bytes."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    word = _words(np.concatenate([data, np.zeros(cap + 16, np.uint8)]), 8)
    width = -(-n // lanes)
    begin = np.arange(0, n, width)
    height = np.zeros(len(begin), np.int64)
    for step in range(width):
        at = begin + step
        if at[-1] >= n:
            begin, height, at = begin[:-1], height[:-1], at[:-1]
        other = before[at]
        height = np.where(other < 0, 0, np.maximum(height - 1, 0))
        open_ = np.flatnonzero((other >= 0) & (height < cap))
        while len(open_):
            h = height[open_]
            differ = word[at[open_] + h] ^ word[other[open_] + h]
            low = (differ & (~differ + np.uint64(1))).astype(np.float64)  # the lowest bit that differs, 0 if none
            same = np.where(differ == 0, 8, np.frexp(low)[1] - 1 >> 3)
            height[open_] = np.minimum(h + same, cap)
            open_ = open_[(same == 8) & (h + 8 < cap)]
        out[at] = height
    return out[order]


def run_of(snippets: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One sorted run: its distinct LENGTH-byte strings in order, the least id of each, and for every start of every snippet the number of its string."""
    sizes = np.fromiter(map(len, snippets), np.int64, len(snippets))
    data = np.frombuffer(b"".join(snippets), np.uint8)
    begin = np.cumsum(sizes) - sizes
    starts = sizes - LENGTH + 1
    place = np.repeat(begin - (np.cumsum(starts) - starts), starts) + np.arange(starts.sum())
    owner = np.full(len(data), LAST_ID, np.int64)
    owner[place] = np.repeat(ids, starts)
    valid = np.zeros(len(data), bool)
    valid[place] = True
    # Kasai's algorithm needs the order of whole suffixes: it infers a height from the neighbour of the suffix one byte before.
    order = suffix_array(data, len(data))
    group = np.cumsum(common_prefixes(data, order, LENGTH) < LENGTH) - 1
    number = np.empty(len(data), np.int64)
    number[order] = group
    least = np.full(group[-1] + 1, LAST_ID, np.int64)
    np.minimum.at(least, group, owner[order])
    used, number = np.unique(number[place], return_inverse=True)
    sample = np.empty(len(used), np.int64)
    sample[number] = place
    strings = np.ndarray((max(len(data) - LENGTH + 1, 0),), f"S{LENGTH}", buffer=data, strides=(1,))[sample]
    # A numpy string drops zero bytes at its end; a void doesn't, but isn't ordered. Zeros are part of the comparison by an equal width.
    return strings, least[used], number


def merge(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
    """Put into every run the least id that any run has for its strings, each looked up by binary search in the others."""
    found = [least.copy() for _, least, _ in runs]
    for i, (a, _, _) in enumerate(runs):
        for j, (b, least, _) in enumerate(runs):
            if i != j and len(b):
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                found[i] = np.where(b[at] == a, np.minimum(found[i], least[at]), found[i])
    for (_, least, _), new in zip(runs, found, strict=True):
        least[:] = new


def _owners_of_shard(classes_each: int, run_classes: int):
    """Answers each row with one row: runs of its string numbers with an earlier owner than the last document that the block has for them."""

    def run(rows: pa.Table) -> pa.Table:
        snippets: list[bytes] = []
        row, number = [], {}
        for i, (blob, sizes) in enumerate(zip(rows.column("snippets").to_pylist(), rows.column("sizes").to_pylist(), strict=True)):
            end = np.cumsum(np.frombuffer(sizes, "u1"), dtype=np.int64)
            snippets += [blob[x:y] for x, y in zip([0, *end[:-1].tolist()], end.tolist(), strict=True)]
            row.append(np.full(len(end), i))
        row = np.concatenate(row)
        cls = np.fromiter((number.setdefault(x, len(number)) for x in snippets), np.int64, len(snippets))
        base, deal = _joined(rows, "first", "<i4").astype(np.int64), _joined(rows, "deal", "<u2").astype(np.int64)
        ids, last = _joined(rows, "least", "<i8"), _joined(rows, "most", "<i8")
        distinct = list(number)
        least, set_of = np.full(len(distinct), LAST_ID, np.int64), np.zeros(len(distinct), np.int64)
        np.minimum.at(least, cls, ids)
        sets = -(-len(distinct) // classes_each)
        set_of[cls] = deal % sets
        found = []
        entry_order = np.argsort(set_of[cls], kind="stable")
        entry_cut = np.searchsorted(set_of[cls][entry_order], np.arange(sets + 1))
        class_order = np.argsort(set_of, kind="stable")
        class_cut = np.searchsorted(set_of[class_order], np.arange(sets + 1))
        place = np.empty(len(distinct), np.int64)
        place[class_order] = np.arange(len(distinct))
        for k in np.flatnonzero(np.diff(class_cut)):
            own = class_order[class_cut[k] : class_cut[k + 1]]
            texts = [distinct[i] for i in own.tolist()]
            runs = [run_of(texts[at : at + run_classes], least[own[at : at + run_classes]]) for at in range(0, len(texts), run_classes)]
            merge(runs)
            owner = np.concatenate([o[string] for _, o, string in runs])
            strings = np.fromiter(map(len, texts), np.int64, len(texts)) - LENGTH + 1
            e = entry_order[entry_cut[k] : entry_cut[k + 1]]
            c = place[cls[e]] - class_cut[k]
            n = strings[c]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            have = owner[np.repeat((np.cumsum(strings) - strings)[c], n) + inside]
            entry = np.repeat(e, n)
            good = np.flatnonzero(have < last[entry])
            if not len(good):
                continue
            have, entry, label = have[good], entry[good], base[entry[good]] + inside[good]
            g = np.flatnonzero(np.r_[True, (entry[1:] != entry[:-1]) | (label[1:] != label[:-1] + 1) | (have[1:] != have[:-1])])
            found.append((row[entry[g]], label[g], np.diff(np.r_[g, len(have)]), have[g]))
        if not found:
            return _table(OWNERS, [])
        of_row, label, n, have = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(of_row, kind="stable")
        packed, have = np.stack([label, n], axis=1).astype("<i4")[order], have[order]
        cut = np.searchsorted(of_row[order], np.arange(rows.num_rows + 1))
        blocks = rows.column("block").to_pylist()
        return _table(OWNERS, [(blocks[i], None, None, packed[cut[i] : cut[i + 1]].tobytes(), have[cut[i] : cut[i + 1]].tobytes()) for i in np.flatnonzero(np.diff(cut)).tolist()])

    return run


def _spans_of_block(rows: pa.Table) -> dict[tuple[int, int], np.ndarray]:
    """For texts of a block (doc_id, h): the [begin, end) intervals of bytes that earlier documents have. rows: OWNERS, of which one or none holds the places."""
    ids = hs = runs = None
    labels, owners = [], []
    for i, h, r, o in zip(*(rows.column(c).to_pylist() for c in ("ids", "hs", "runs", "owners")), strict=True):
        if ids is None and i is not None:
            ids, hs, runs = np.frombuffer(i, "<i8"), np.frombuffer(h, "<i8"), np.frombuffer(r, "<i4").reshape(-1, 4).astype(np.int64)
        elif o is not None:
            labels.append(np.frombuffer(r, "<i4").reshape(-1, 2).astype(np.int64))
            owners.append(np.frombuffer(o, "<i8"))
    if ids is None or not labels:
        return {}
    docs, begin, first, count = runs.T
    label, owner = np.concatenate(labels), np.concatenate(owners)
    of_string = np.full(int((first + count).max()), LAST_ID, np.int64)
    inside = np.arange(label[:, 1].sum()) - np.repeat(np.cumsum(label[:, 1]) - label[:, 1], label[:, 1])
    of_string[np.repeat(label[:, 0], label[:, 1]) + inside] = np.repeat(owner, label[:, 1])
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    doc, at = np.repeat(docs, count), np.repeat(begin, count) + inside
    gone = of_string[np.repeat(first, count) + inside] < ids[doc]
    doc, at = doc[gone], at[gone]
    if not len(doc):
        return {}
    g = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)])
    pairs = np.stack([at[g], at[np.r_[g[1:], len(at)] - 1] + LENGTH], axis=1)
    own = doc[g]
    cut = np.r_[_groups(own), len(own)]
    return {(int(ids[own[a]]), int(hs[own[a]])): pairs[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)}


def _resolve(docs: DataFrame, text_col: str, finish, schema: str) -> DataFrame:
    """finish(rows, texts, spans) for each table of rows (struct column `row` of all columns of docs but the text, their texts as bytes or None, and
    for each None, intervals, or True for a text to be removed whole)."""
    spark = docs.sparkSession
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col))
    text = F.col(f"`{text_col}`")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"), others.alias("row"))
    slim = materialize(keyed.where(F.octet_length("text") >= LENGTH).select("id", "h", F.md5("text").alias("m"), F.octet_length("text").alias("n")), "slim")
    total = slim.agg(F.sum("n")).first()[0] or 0
    firsts = slim.groupBy("h", "m").agg(F.min("id").alias("first"), F.max("id").alias("last")).where(F.col("first") < F.col("last"))
    firsts = materialize(firsts, "firsts")
    copies = materialize(slim.join(broadcast_if_small(firsts, firsts.count(), BROADCAST_ROWS), ["h", "m"]).where(F.col("id") > F.col("first")).select("id", "h").distinct(), "copies")
    copies = broadcast_if_small(copies, copies.count(), BROADCAST_ROWS)
    blocks = max(1, -(-total // BLOCK_BYTES))
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARE_BYTES))
    long_ = F.octet_length("text") >= LENGTH
    own = keyed.where(long_).join(copies, ["id", "h"], "left_anti")
    # Rows that repeat with their id share one representative in the blocks, and get what is found for it.
    repeats = slim.groupBy("id", "h").agg(F.count("*").alias("rows")).where("rows > 1").join(copies, ["id", "h"], "left_anti").select("id", "h")
    repeats = materialize(repeats, "repeats")
    n_repeats = repeats.count()
    if n_repeats:
        side = broadcast_if_small(repeats, n_repeats, BROADCAST_ROWS)
        again = own.join(side, ["id", "h"], "left_semi")
        one = again.groupBy("id", "h").agg(F.first("text").alias("text")).select("id", "h", "text", F.lit(None).cast(keyed.schema["row"].dataType).alias("row"))
        own = own.join(side, ["id", "h"], "left_anti").select("id", "h", "text", "row").union(one)
    texts = own.withColumn("block", F.pmod(F.xxhash64("id", "h"), F.lit(blocks)))
    grouped = texts.groupBy("block")
    shared = grouped.applyInArrow(_hashes_of_block(shares), HASHES).groupBy("bucket").applyInArrow(_shared_in_bucket(CROWDED), SHARED)
    entries = materialize(grouped.cogroup(shared.groupBy("block")).applyInArrow(_entries_of_block(shares), ENTRIES), "entries")
    owners = entries.where("shard IS NOT NULL").groupBy("shard").applyInArrow(_owners_of_shard(SHARD_CLASSES, RUN_CLASSES), OWNERS)
    kept = entries.where("shard IS NULL").select("block", "ids", "hs", "runs", F.lit(None).cast("binary").alias("owners"))
    answers = materialize(kept.union(owners), "owners")

    def finished(rows: pa.Table, answers: pa.Table) -> pa.Table:
        spans = _spans_of_block(answers)
        rows = rows.filter(pc.is_valid(rows.column("row")))
        ids, hs = _numbers(rows, "id", "h")
        return finish(rows.column("row"), [t.as_py().encode() for t in rows.column("text")], [spans.get(k) for k in zip(ids.tolist(), hs.tolist(), strict=True)])

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py().encode() if t.is_valid else None for t in b.column(1)]
            yield from finish(pa.chunked_array([b.column(0)]), texts, [True if c else None for c in b.column(2).to_pylist()]).to_batches()

    def of_repeats(rows: pa.Table, answers: pa.Table) -> pa.Table:
        """The intervals of the rows' representatives."""
        spans = _spans_of_block(answers)
        ids, hs = _numbers(rows, "id", "h")
        found = [spans.get(k) for k in zip(ids.tolist(), hs.tolist(), strict=True)]
        return pa.table({"id": pa.array(ids), "h": pa.array(hs), "spans": pa.array([None if x is None else x.astype("<i8").tobytes() for x in found], pa.binary())})

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [None if x is None else np.frombuffer(x, "<i8").reshape(-1, 2) for x in b.column(2).to_pylist()]
            yield from finish(pa.chunked_array([b.column(0)]), [t.as_py().encode() for t in b.column(1)], spans).to_batches()

    marked = keyed.where(~F.coalesce(long_, F.lit(False))).select("row", "text", F.lit(False).alias("copy"))
    marked = marked.union(keyed.where(long_).join(copies, ["id", "h"], "left_semi").select("row", "text", F.lit(True).alias("copy")))
    out = grouped.cogroup(answers.groupBy("block")).applyInArrow(finished, schema).union(marked.mapInArrow(untouched, schema))
    if n_repeats:
        spans = texts.where("row IS NULL").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(of_repeats, "id bigint, h bigint, spans binary")
        spans = broadcast_if_small(materialize(spans, "spans"), n_repeats, BROADCAST_ROWS)
        out = out.union(again.join(spans, ["id", "h"]).select("row", "text", "spans").mapInArrow(repeated, schema))
    return out


def kept_bytes(data: bytes, spans: np.ndarray | bool | None) -> tuple[bytes, int]:
    """What remains, and the number of maximal removed runs. spans: [begin, end) intervals, or True for the whole."""
    if spans is None:
        return data, 0
    if spans is True:
        return b"", 1
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, spans[:, 0], 1)
    np.add.at(change, spans[:, 1], -1)
    gone = np.cumsum(change[:-1]) > 0
    runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), runs


def removals(docs: DataFrame) -> DataFrame:
    """What op6 returns: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def digests(rows: pa.ChunkedArray, texts: list[bytes | None], spans: list) -> pa.Table:
        found = []
        for text, own in zip(texts, spans, strict=True):
            kept, runs = kept_bytes(text or b"", own)
            found.append((len(text or b""), len(text or b"") - len(kept), runs, hashlib.sha256(kept).hexdigest()))
        columns = [pa.array([r[i] for r in found], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.string()])]
        return pa.table([pc.struct_field(rows, [0]), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return _resolve(own, "text", digests, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def strip(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the repeated bytes removed from their texts (a character that loses some of its bytes goes); other columns as they are."""
    names = docs.columns

    def stripped(rows: pa.ChunkedArray, texts: list[bytes | None], spans: list) -> pa.Table:
        new = pa.array([None if t is None else kept_bytes(t, own)[0].decode("utf-8", "ignore") for t, own in zip(texts, spans, strict=True)], pa.string())
        at, others = names.index(text_col), iter(range(len(names) - 1))
        return pa.table([new if i == at else pc.struct_field(rows, [next(others)]) for i in range(len(names))], names=names)

    return _resolve(docs, text_col, stripped, docs.schema)
