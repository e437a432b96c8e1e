"""Secret scan by a trigram inverted index.

Each rule is a regular expression. From its parse tree a Boolean query over trigrams is derived (an AND of the trigrams of
every literal stretch, an OR over alternatives). Every block of documents gets an inverted index: trigram to the sorted
positions of the documents that contain it, over the case-folded UTF-8 bytes of the whole texts. A rule's query is answered by
intersecting and uniting postings, and only the candidates are matched with the expression. A rule whose
expression has no mandatory trigram (a bare character class) is matched against every document.

The index is a set of independent segments, one for each 1,000 rows of an Arrow batch, so nothing is shuffled, a lost executor costs only its own
blocks, and memory is bounded by a batch. Only trigrams that some rule asks for get postings.

Null text counts as empty; texts of any length are read whole, a batch at a time. Documents without spans stay, with zero counts. Repeated rows each give a row; an
empty table gives none. Extra columns, whatever their names, are dropped by `scan` and kept by `redact`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import spare


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group whose length counts, and the least length.
    group: int = 0
    least: int = 0


# The base kinds, in the order in which ties sort.
BASE_RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # All maximal runs of the class that are long enough: the same as matching [0-9a-f]+ and dropping the short ones.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Formats of well-known credentials; each has mandatory trigrams, so documents without them are never matched.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("map_key", r"AIza[0-9A-Za-z_-]{35}"),
)
RULES = BASE_RULES + MORE_RULES

#: A query is True (any document), ("tri", bytes), ("and", [..]) or ("or", [..]).
Query = bool | tuple
_MOST_EXACT = 64


def _and(parts: list[Query]) -> Query:
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _or(parts: list[Query]) -> Query:
    return True if any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", parts)


def _of_strings(strings: set[bytes]) -> Query:
    """Some string of the set occurs: for each the AND of its trigrams."""
    return _or([_and([("tri", t) for t in sorted({s[i : i + 3] for i in range(len(s) - 2)})]) for s in sorted(strings)])


def _fold(code: int) -> bytes:
    return chr(code).encode().lower() if code < 128 else chr(code).encode()


def _walk(items) -> tuple[set[bytes] | None, Query]:
    """The exact set of (folded) strings that the sequence matches, or None; and a query that every match satisfies."""
    exact: set[bytes] | None = {b""}
    run, queries = {b""}, []

    def flush(also: Query = True):
        nonlocal run, exact
        queries.extend([_of_strings(run), also])
        run, exact = {b""}, None

    for op, arg in items:
        sub, query = None, True
        if op is sre.LITERAL:
            sub = {_fold(arg)}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
            sub = {_fold(a) for _, a in arg}
        elif op is sre.SUBPATTERN:
            sub, query = _walk(arg[-1])
        elif op is sre.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in parts):
                sub = set().union(*(s for s, _ in parts))
            query = _or([q for _, q in parts])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, body = arg
            inner, q = _walk(body)
            if inner is not None and most == 1:
                sub = inner | ({b""} if least == 0 else set())
            else:
                query = q if least else True
        elif op is sre.AT:
            continue
        if sub is not None and len(sub) * len(run) <= _MOST_EXACT:
            run = {a + b for a in run for b in sub}
            if exact is not None:
                exact = run
        elif sub is not None:
            flush()
            run = set(sub)
        else:
            flush(query)
    queries.append(_of_strings(run))
    return exact, _and(queries)


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of an expression; True if it has no mandatory trigram."""
    return _walk(sre_parse.parse(pattern))[1]


def _trigrams(q: Query) -> set[bytes]:
    return set() if q is True else {q[1]} if q[0] == "tri" else set().union(*map(_trigrams, q[1]))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = 1 << 22


def _numbers(vocabulary: list[bytes]) -> np.ndarray:
    """For each trigram its number in the vocabulary from 1, or 0."""
    table = np.zeros(1 << 24, np.uint16)
    for i, t in enumerate(vocabulary):
        table[t[0] << 16 | t[1] << 8 | t[2]] = i + 1
    return table


class Segment:
    """The inverted index of one block of UTF-8 texts: `data` with `offsets` of each text's start."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, vocabulary: list[bytes], table: np.ndarray | None = None):
        """table: that of the vocabulary, if it is at hand."""
        self.n, self.ids = len(offsets) - 1, {t: i + 1 for i, t in enumerate(vocabulary)}
        table = _numbers(vocabulary) if table is None else table
        found = []
        for at in range(int(offsets[0]), int(offsets[-1]), _STEP):
            x = _LOWER[data[at : min(at + _STEP + 2, int(offsets[-1]))]].astype(np.int32)
            if len(x) < 3:
                continue
            ids = table[(x[:-2] << 16) | (x[1:-1] << 8) | x[2:]]
            where = np.flatnonzero(ids)
            ids, where = ids[where].astype(np.int64), where + at
            doc = np.searchsorted(offsets, where, "right") - 1
            whole = where + 3 <= offsets[doc + 1]
            found.append(np.unique(ids[whole] * self.n + doc[whole]))
        keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        cut = np.searchsorted(keys, np.arange(1, len(vocabulary) + 2) * self.n)
        self.postings = {t: keys[cut[i - 1] : cut[i]] - i * self.n for t, i in self.ids.items()}

    def candidates(self, q: Query) -> np.ndarray:
        if q is True:
            return np.arange(self.n)
        if q[0] == "tri":
            return self.postings[q[1]]
        parts = sorted((self.candidates(p) for p in q[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if q[0] == "and" else np.union1d(out, p)
        return out


def _block(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A string column without nulls, its bytes and offsets."""
    column = column.fill_null("") if column.null_count else column
    if column.offset:  # a slice's buffers begin before it
        column = pa.concat_arrays([column.slice(0, 0), column])
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return column, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern), trigram_query(r.pattern)) for r in rules]
        self.vocabulary = sorted(set().union(*(_trigrams(q) for _, _, q in self.rules)))
        self.numbers = _numbers(self.vocabulary)

    def spans(self, column: pa.Array) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
        """The texts, and for each the spans (start, number of the rule, end) in order."""
        column, data, offsets = _block(column)
        texts = column.to_pylist()
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not texts:
            return texts, out
        segment = Segment(data, offsets, self.vocabulary, self.numbers)
        for k, (rule, compiled, query) in enumerate(self.rules):
            for i in segment.candidates(query):
                for m in compiled.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[i].append((m.start(), k, m.end()))
        for x in out:
            x.sort()
        return texts, out


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document its spans as an array of (kind, start, end) in code points, end exclusive, by start and then rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for b in spare(batches):
            _, found = scanner.spans(b.column(1))
            rows = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in found]
            yield pa.record_batch([b.column(0), pa.array(rows, SPANS)], names=[id_col, "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_digests(docs: DataFrame) -> DataFrame:
    """What op1 returns: counts of the base kinds, a digest of the base spans and all spans as text."""
    base = [r.kind for r in BASE_RULES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(RULES)
        for b in spare(batches):
            _, found = scanner.spans(b.column(1))
            counts = [[sum(k == i for _, k, _ in x) for x in found] for i in range(len(base))]
            show = lambda x: ",".join(f"{RULES[k].kind}:{s}:{e}" for s, k, e in x)
            digests = [hashlib.sha256(show([y for y in x if y[1] < len(base)]).encode()).hexdigest() for x in found]
            yield pa.record_batch(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array([show(x) for x in found], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """docs with every span (overlapping ones united) replaced by [kind] of its first rule; other columns as they are, null stays null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for b in spare(batches):
            texts, found = scanner.spans(b.column(at))
            for i, spans in enumerate(found):
                if not spans:
                    continue
                parts, last, text = [], 0, texts[i]
                for start, k, end in spans:
                    if start >= last:
                        parts += [text[last:start], f"[{rules[k].kind}]"]
                    last = max(last, end)
                texts[i] = "".join(parts) + text[last:]
            new = pa.array([None if null else t for t, null in zip(texts, b.column(at).is_null().to_pylist(), strict=True)], b.column(at).type)
            yield b.set_column(at, b.schema.field(at).name, new)

    return docs.mapInArrow(run, docs.schema)
