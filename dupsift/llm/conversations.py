"""Repair of the turn structure of conversations by error-correcting Earley parsing.

A conversation's rows, by turn (nulls first, then by role and text), are parsed by a weighted role grammar: an optional system row, then pairs of user and
assistant, or nothing. Terminals have error productions: a row is deleted (cost 3), gets another role (2), or an empty row is inserted (2). The
chart's items keep their minimum of (cost, audit), the audit being the edits' initials K, R, D, I in order; the completed goal item is the repair. The grammar is
left recursive, so each item begins at the first row and a column has a handful of items however long the conversation is.

Faults of rows, the first of these: blank (no character but white space), duplicate (an earlier row has the same role and text), truncated (the last character is
none of .!?). Blank and duplicate rows must be deleted; a truncated row that stays costs 1 more.

Equal rows are counted as one with a number of copies before conversations are brought together, and what is a duplicate is decided by grouped minima, so no hot
text is gathered. A conversation itself is a sequence: one task reads it as a sorted stream, first its roles and faults alone (the parse), then its texts beside
the finished audit. Neither pass holds more than the audit (a few bytes a row) and a batch.

Nulls in any column count as one space, but a null turn sorts first and a null conv_id is a conversation of its own. Texts may be empty or of any length. A role that begins
with none of s, u, a (also an empty one) can't be kept. Rows that repeat are duplicates. An empty table gives an empty one; extra columns, whatever their names, are dropped.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

END = "$"
#: Productions (left side, right side). Small letters are roles' initials.
GRAMMAR = [
    ("Goal", ("Turns", END)),
    ("Turns", ()),
    ("Turns", ("Body",)),
    ("Body", ("Head", "u", "a")),
    ("Body", ("Body", "u", "a")),
    ("Head", ()),
    ("Head", ("s",)),
]
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED_STAYS = 2, 3, 2, 1
SPACE = " \t\n\x0b\f\r"
#: Flags of a row.
GOOD, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Productions by the symbol that they begin with, and those that are complete at once.
_STARTS = {s: [i for i, (_, right) in enumerate(GRAMMAR) if right and right[0] == s] for s in {left for left, _ in GRAMMAR}}
_NEXT = {(i, d): right[d] if d < len(right) else None for i, (_, right) in enumerate(GRAMMAR) for d in range(len(right) + 1)}


class Chart:
    """The columns of one conversation, of which only the last is kept. An item is a production and the place of its dot; its value is (cost, rank, inserts): the audit up
    to the last row, as its rank among the column's, and the number of rows inserted since. Audits of one column and cost are never prefixes of each other, so
    ranks and inserts compare them as the strings would."""

    def __init__(self) -> None:
        # Items that await a terminal; predicted ones have read nothing. Audits are chains of (audit before, edits).
        start = {(i, 0): ((0, 0, 0), None) for i, (_, right) in enumerate(GRAMMAR) if not right or _NEXT[i, 0] in ("s", "u", "a")}
        self.column = self._closed(start)

    @staticmethod
    def _closed(items: dict) -> dict:
        """Complete and insert until nothing changes; cheapest first, so each item is settled once."""
        heap = [(value, item, chain) for item, (value, chain) in items.items()]
        heapq.heapify(heap)
        done: dict = {}
        while heap:
            value, item, chain = heapq.heappop(heap)
            if item in done:
                continue
            done[item] = (value, chain)
            symbol = _NEXT[item]
            if symbol is None:
                for i in _STARTS[GRAMMAR[item[0]][0]]:
                    heapq.heappush(heap, (value, (i, 1), chain))
            elif symbol in ROLES:
                heapq.heappush(heap, ((value[0] + INSERT, value[1], value[2] + 1), (item[0], item[1] + 1), chain))
        return done

    def scan(self, initial: str, flag: int) -> None:
        """Read a row: every item that awaits a terminal deletes it, takes it, or takes it under another role."""
        best: dict = {}
        stays = flag not in (BLANK, DUPLICATE)
        extra = TRUNCATED_STAYS if flag == TRUNCATED else 0
        for (i, d), ((cost, rank, inserts), chain) in self.column.items():
            symbol = _NEXT[i, d]
            if symbol is None or symbol in _STARTS:
                continue
            choices = [((i, d), cost + DELETE, "D")]
            if stays and symbol == initial:
                choices.append(((i, d + 1), cost + extra, "K"))
            elif stays and symbol in ROLES:
                choices.append(((i, d + 1), cost + extra + REROLE, "R"))
            for item, total, edit in choices:
                new = (total, rank, "I" * inserts + edit)
                if item not in best or new < best[item][0]:
                    best[item] = (new, chain)
        ranks = {key: n for n, key in enumerate(sorted({value[1:] for value, _ in best.values()}))}
        self.column = self._closed({item: ((v[0], ranks[v[1:]], 0), (chain, v[2])) for item, (v, chain) in best.items()})

    def result(self) -> tuple[int, str]:
        """Cost and audit of the completed goal."""
        (cost, _, inserts), chain = self.column[0, 1]
        pieces = ["I" * inserts]
        while chain is not None:
            chain, piece = chain
            pieces.append(piece)
        return cost, "".join(reversed(pieces))


def parse(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """Cost and audit of rows of (role's initial, flag)."""
    chart = Chart()
    for initial, flag in rows:
        chart.scan(initial, flag)
    return chart.result()


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in, by a checksum of conversation and turn; nulls in role and text become a space."""
    spelled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(spelled[0], F.lit(":"), spelled[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.explode(F.array_repeat(F.lit(0), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)))
    return conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), copies.alias("_")).drop("_")


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of distinct rows, with n (copies), initial (of the role; ? for others than s, u, a) and flag (of the first copy; others are blank or duplicates)."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    counted = rows.select("conv_id", "turn", role.alias("role"), text.alias("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    keyed = counted.withColumn("m", F.md5("text")).withColumn("at", F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn").alias("turn")))
    firsts = keyed.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("m").alias("k")).agg(F.count("*").alias("turns"), F.min("at").alias("first")).where("turns > 1").drop("turns")
    joined = keyed.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("m") == F.col("k")), "left")
    ended = F.rtrim("text", F.lit(SPACE))
    later = F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    flag = F.when(ended == "", BLANK).when(later, DUPLICATE).when(~F.substring(ended, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(GOOD)
    initial = F.substring("role", 1, 1)
    return joined.select("conv_id", "turn", "role", "text", "n", F.when(initial.isin("s", "u", "a"), initial).otherwise("?").alias("initial"), flag.alias("flag"))


def _streams(df: DataFrame, key: str, order: list, columns: list[str], function: Callable, schema: str) -> DataFrame:
    """function over the rows of each task, sorted by key and order; a key's rows are in one task, one after the other."""
    return df.repartition(F.col(key)).sortWithinPartitions(F.col(key), *order).select(*columns).mapInArrow(function, schema)


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _tables(rows: Iterator[tuple], schema: pa.Schema, most: int = 1_000, most_chars: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of `most` rows or about most_chars characters."""
    held, chars = [], 0
    for r in rows:
        held.append(r)
        chars += sum(len(x) for x in r if isinstance(x, str))
        if len(held) >= most or chars >= most_chars:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_LONGS = [(c, pa.int64()) for c in COUNTS]
_PARSED = "conv_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string"


class _Parsing:
    """The counts and the chart of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.chart = conv_id, Chart()
        self.faults, self.illegal, self.before = [0, 0, 0, 0], 0, None
        self.least = self.most = None
        self.turns = 0

    def read(self, turn: int | None, initial: str, flag: int, n: int) -> None:
        if turn is not None and turn != self.most:  # turns rise
            self.least = turn if self.least is None else self.least
            self.most, self.turns = turn, self.turns + 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.illegal += n - 1
        self.before = initial
        rest = BLANK if flag == BLANK else DUPLICATE
        self.faults[flag] += 1
        self.faults[rest] += n - 1
        self.chart.scan(initial, flag)
        for _ in range(n - 1):
            self.chart.scan(initial, rest)

    def row(self) -> tuple:
        cost, audit = self.chart.result()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (self.conv_id, gaps, *self.faults[1:], self.illegal, cost, audit)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        now = None
        for conv_id, turn, initial, flag, n in _tuples(batches):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    yield now.row()
                now = _Parsing(conv_id)
            if n:
                now.read(turn, initial, flag, n)
        if now is not None:
            yield now.row()

    yield from _tables(rows(), pa.schema([("conv_id", pa.int64()), *_LONGS, ("audit", pa.string())]))


def _applied(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Events of a stream of headers (audit set) and rows: (header, None) where a conversation begins, then (header, (edit, turn, role, text)) for each repaired row."""
    header, audit, at, last = None, "", 0, ""

    def inserted(to: int) -> Iterator[tuple]:
        nonlocal at, last
        while at < to and audit[at] == "I":
            at, last = at + 1, ROLES["a" if last == "u" else "u"][0]
            yield header, ("I", None, ROLES[last], "")

    for conv_id, *counts, full, turn, role, text, n in rows:
        if full is not None:
            yield from inserted(len(audit))
            header, audit, at, last = (conv_id, *counts, full), full, 0, ""
            yield header, None
            continue
        for _ in range(n):
            yield from inserted(len(audit))
            edit, at = audit[at], at + 1
            if edit != "D":
                own = ROLES["a" if last == "u" else "u"] if edit == "R" else role
                last = own[0]
                yield header, (edit, turn, own, text)
    yield from inserted(len(audit))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        own, digest, some = None, None, False
        for header, row in _applied(_tuples(batches)):
            if row is None:
                if own is not None:
                    yield (*own, digest.hexdigest())
                own, digest, some = header, hashlib.sha256(), False
            else:
                digest.update(f"{chr(10) if some else ''}{row[2]}:{row[3]}".encode())
                some = True
        if own is not None:
            yield (*own, digest.hexdigest())

    yield from _tables(rows(), pa.schema([("conv_id", pa.int64()), *_LONGS, ("audit", pa.string()), ("repaired_sha256", pa.string())]))


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        place = 0
        for header, row in _applied(_tuples(batches)):
            place = 0 if row is None else place + 1
            if row is not None:
                yield (header[0], place - 1, *row)

    yield from _tables(rows(), pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))


def _with_audits(rows: DataFrame, ids: DataFrame, function: Callable, schema: str) -> DataFrame:
    """function over sorted streams of each conversation's header (counts and audit) and rows. ids: the conversations to report, of which some may have no rows."""
    order = [F.asc_nulls_first("turn"), "role", "text"]
    whole = [F.col(c).cast("bigint").alias(c) for c in ("conv_id", "turn")]
    flagged = materialize(faults(rows.select(*whole, "role", "text")), "rows")
    there = ids.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    empty = there.select("conv_id", *[F.lit(None).cast(flagged.schema[c].dataType).alias(c) for c in ("turn", "role", "text")], F.lit(0).cast("bigint").alias("n"), F.lit("?").alias("initial"), F.lit(GOOD).alias("flag"))
    parsed = materialize(_streams(flagged.union(empty), "conv_id", order, ["conv_id", "turn", "initial", "flag", "n"], _parsed, _PARSED), "parsed")
    heads = parsed.select("*", *[F.lit(None).cast(flagged.schema[c].dataType).alias(c) for c in ("turn", "role", "text", "n")])
    body = flagged.select("conv_id", *[F.lit(None).cast("bigint").alias(c) for c in COUNTS], F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "n")
    return _streams(heads.union(body), "conv_id", [F.col("audit").isNull(), *order], heads.columns, function, schema)


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), edit (K, R or I), turn (null for inserted rows), role, text."""
    schema = "conv_id bigint, position bigint, edit string, turn bigint, role string, text string"
    return _with_audits(conversations, conversations, _repaired, schema)


def repair_digests(conversations: DataFrame) -> DataFrame:
    """What op12 returns of the damaged conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    return _with_audits(damage(conversations), conversations, _digests, _PARSED + ", repaired_sha256 string")
