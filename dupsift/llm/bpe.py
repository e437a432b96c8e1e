"""Byte-level BPE by prefix dynamic programming.

The encoding of every prefix of a byte string ends in one valid token, and the prefix without that token is again encoded
by the stored entry of its own length. So for each prefix only its last token is kept: the one token that is a suffix of
the prefix and forms a valid pair with the last token of what comes before (a pair is valid if encoding the two tokens'
bytes gives back these two tokens). Reading the table backwards gives the encoding. The table of a longer
string extends that of its prefix, so appending is exact and costs only the new bytes, and an edit needs new entries
only from the piece that it touches to the first piece boundary that is as before.

Null text counts as empty, and empty texts have no tokens; texts of any length are encoded whole. Repeated rows each give a row; an empty table gives none. Extra
columns, whatever their names, are dropped. The ranks' path is a parameter; the file is read once in each Python worker, which keeps its tables until a task of another operator begins there.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import KEPT, spare

#: Entries of a worker's caches (pieces, pairs); full caches are emptied, which changes no result.
MOST_CACHED = 300_000
NEVER = 1 << 40
#: Texts, or bytes if fewer, that are encoded together.
TOGETHER, BYTES = 4096, 1 << 21


class PrefixBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.longest = max(map(len, ranks))
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.tokens[r] = b
        self.sizes = [len(t) for t in self.tokens]
        self.lengths = np.array(self.sizes, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.pairs: dict[int, bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        #: Piece to its ids as little-endian 32-bit integers.
        self.packed: dict[str, bytes] = {}

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        data = self.tokens[token]
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            _, i = min((self.ranks.get(parts[i] + parts[i + 1], len(self.tokens)), i) for i in range(len(parts) - 1))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at the token's end (side 1) or beginning (side 0) while it is merged: (token, rank of the merge that
        ends it), first to last."""
        known = self.spines[side].get(token)
        if known is None:
            known, until, at = [(token, NEVER)], token, self._halves(token)
            while at:
                known.append((at[side], until))
                until, at = at[side], self._halves(at[side])
            known.reverse()
            self.spines[side][token] = known
        return known

    def valid(self, a: int, b: int) -> bool:
        """Whether token b can follow token a inside one piece: no merge across their border comes before the merges that use up
        the tokens beside the border (an equal rank goes to the one further left)."""
        left, right, i, j = self._spine(a, 1), self._spine(b, 0), 0, 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            across = self.ranks.get(self.tokens[x] + self.tokens[y])
            if across is not None and across < x_ends and across <= y_ends:
                return False
            if x_ends == y_ends == NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def extend(self, last: list[int], data: bytes) -> list[int]:
        """Complete the table `last` (the last token of each prefix, from length 1) so that it covers all of data."""
        get, pairs = self.ranks.get, self.pairs
        if len(pairs) > MOST_CACHED:
            pairs.clear()
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(end - self.longest if end > self.longest else 0, end):
                token = get(data[start:end])
                if token is not None:
                    if not start:
                        break
                    key = last[start - 1] << 32 | token
                    ok = pairs.get(key)
                    if ok is None:
                        ok = pairs[key] = self.valid(last[start - 1], token)
                    if ok:
                        break
            else:
                raise ValueError(f"the ranks lack byte {data[end - 1]}")
            last.append(token)
        return last

    def backward(self, last: list[int]) -> list[int]:
        out, at, sizes = [], len(last), self.sizes
        while at:
            token = last[at - 1]
            out.append(token)
            at -= sizes[token]
        out.reverse()
        return out

    def piece(self, data: bytes) -> list[int]:
        return self.backward(self.extend([], data))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Pieces not seen before are taken in order, so that each begins with the table of the prefix
        that it shares with the one before."""
        known: dict[str, str] = {}  # one string for all that are equal
        split = [[known.setdefault(p, p) for p in self.split.findall(t)] for t in texts]
        packed = self.packed
        if len(packed) > MOST_CACHED:
            packed.clear()
        before, table = b"", []
        for piece in sorted(p for p in known if p not in packed):
            data = piece.encode()
            short = min(len(data), len(before))
            differ = int.from_bytes(data[:short]) ^ int.from_bytes(before[:short])
            table = self.extend(table[: short - (differ.bit_length() + 7) // 8], data)
            packed[piece] = array("I", self.backward(table)).tobytes()
            before = data
        return [np.frombuffer(b"".join(map(packed.__getitem__, x)), "<u4") for x in split]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        parts = []
        for at in range(0, len(ids), 1 << 18):
            own = ids[at : at + (1 << 18)]
            n = self.lengths[own]
            ends = np.cumsum(n)
            parts.append(self.blob[np.repeat(self.starts[own] - (ends - n), n) + np.arange(ends[-1])].tobytes())
        return b"".join(parts)


class Encoded:
    """A text with its pieces and their prefix tables, for exact appends and local re-encoding."""

    #: How far the pattern's choice can depend on what follows a piece (an apostrophe with two letters).
    AHEAD = 3

    def __init__(self, bpe: PrefixBPE, text: str = ""):
        self.bpe, self.text, self.starts, self.tables = bpe, "", [], []
        #: Pieces encoded by the last call, to show that work is local.
        self.encoded = 0
        self.replace(0, 0, text)

    def ids(self) -> list[int]:
        return [t for x in self.tables for t in self.bpe.backward(x)]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end]; tables of pieces before and after that stay as they are are kept."""
        old, starts, tables = self.text, self.starts, self.tables
        text = old[:start] + new + old[end:]
        ends = [*starts[1:], len(old)]
        keep = 0
        while keep < len(starts) and ends[keep] <= start - self.AHEAD:
            keep += 1
        if keep and keep == len(starts) or (keep and old[starts[keep - 1] : ends[keep - 1]].isspace()):
            keep -= 1  # a run of white space can end otherwise
        shift = len(text) - len(old)
        later = {s + shift: i for i, s in enumerate(starts) if s >= end}
        at = starts[keep] if keep < len(starts) else (len(old[:start]) if not starts else 0)
        if not starts:
            at = 0
        new_starts, new_tables, self.encoded = starts[:keep], tables[:keep], 0
        reuse = {s: t for s, t in zip(starts[keep:], tables[keep:], strict=True) if s <= start}
        for m in self.bpe.split.finditer(text, at):
            if m.start() in later and m.start() >= start + len(new):
                i = later[m.start()]
                new_starts += [s + shift for s in starts[i:]]
                new_tables += tables[i:]
                break
            data = m.group().encode()
            table = []
            if m.start() in reuse:  # the prefix before the edit keeps its entries
                same = len(text[m.start() : min(start, m.end())].encode())
                table = reuse[m.start()][:same]
            new_starts.append(m.start())
            new_tables.append(self.bpe.extend(table, data))
            self.encoded += 1
        self.text, self.starts, self.tables = text, new_starts, new_tables


@functools.cache
def load(path: str, pattern: str) -> PrefixBPE:
    with open(path, "rb") as f:
        return PrefixBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids adds the ids. One row for each row of docs, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        KEPT["bpe"] = load.cache_clear
        for b in spare(batches, "bpe"):
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
            at = 0
            while at < len(sizes):
                end, size = at, 0
                while end < len(sizes) and end - at < TOGETHER and size < BYTES:
                    size += sizes[end]
                    end += 1
                coded = bpe.encode_all([t or "" for t in b.column(1).slice(at, end - at).to_pylist()])
                columns = [
                    b.column(0).slice(at, end - at),
                    pa.array([len(x) for x in coded], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in coded], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in coded], pa.string()),
                ]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in coded], pa.list_(pa.int32())))
                yield pa.record_batch(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])
                at = end

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)
