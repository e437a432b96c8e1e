"""Spelling variants: the words of a vocabulary that differ by one inserted, deleted or replaced code point, and the form that each is a variant of.

The vocabulary's trie joins itself. With a trie node go its active nodes, those within distance one of it; they follow from its parent's: the node itself at distance
zero, and at distance one its parent (a deletion), its siblings (a replacement), its children (an insertion) and, of the parent's active nodes at distance one, the children by the
same letter. Where both ends are words, a pair is found.

The trie is partitioned by prefixes. Of two words at distance one, of lengths L and L or L + 1, let x be what they share before the edit and y behind it: |x| + |y| >= L - 1. So
with p + q = L they share the first p code points or the last q. Each word is dealt by both, for L its length and its length less one, and each partition joins
the trie of what is between (behind the prefix, or before the suffix). A partition with more than PART_CHARS between is dealt again in the same way by what is between,
until it is small or one place is left, where the alphabet bounds it. So no popular prefix makes a large task, and no pair is lost.

A word's form is its near word with the largest count, of ties the least in code-point order, if that is at least FACTOR times the word's own; its root is what
following forms leads to. Forms grow FACTOR-fold, so chains end; they are followed by doubling steps.

Null text has no words, and a null doc_id counts as an empty string. Texts of any length are read whole, in pieces cut between words. Words may be of any length. Repeated rows
count as often as they are there. An empty table gives an empty one; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop_table, materialize

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_CHARS, LEAST_COUNT, FACTOR = 6, 5, 5
#: One run in so many loses a code point when a text is read with damage.
DAMAGE = 199
#: Code points between prefix and suffix, over all words of a partition, beyond which it is dealt again; keys of such partitions that are broadcast.
PART_CHARS, BROADCAST_ROWS = 100_000, 500_000
#: Distinct words that a task holds before it hands their counts on, and characters of text that are read at once.
HELD_WORDS, PIECE_CHARS = 300_000, 1 << 20


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of about `size` characters, none cut within a run of letters."""
    at = 0
    while len(text) - at > size:
        end = LETTERS.match(text, at + size)
        end = end.end() if end else at + size
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def lower_ascii(text: str) -> str:
    return text.encode().lower().decode()


def damaged(word: str, h: int) -> str:
    """The word, or without one code point where DAMAGE divides its checksum."""
    if h % DAMAGE:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def vocabulary(docs: DataFrame, damage: bool = True) -> DataFrame:
    """word, n: words of at least LEAST_CHARS code points and LEAST_COUNT occurrences. Counts are summed in each task before they are exchanged."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not text.is_valid:
                    continue
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for piece in pieces(lower_ascii(text.as_py())):
                    for w, n in Counter(LETTERS.findall(piece)).items():
                        if len(w) < LEAST_CHARS:
                            continue
                        if damage:
                            w = damaged(w, zlib.crc32(w.encode(), start))
                            if len(w) < LEAST_CHARS:
                                continue
                        held[w] += n
                if len(held) >= HELD_WORDS:
                    yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())}, pa.schema([("word", pa.string()), ("n", pa.int64())]))
                    held = Counter()
        if held:
            yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())}, pa.schema([("word", pa.string()), ("n", pa.int64())]))

    return docs.select("doc_id", "text").mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def trie_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """Places of two words at distance one, in both orders. Words are distinct."""
    children: list[dict[str, int]] = [{}]
    ends: dict[int, int] = {}
    for i, w in enumerate(words):
        node = 0
        for c in w:
            node = children[node].setdefault(c, len(children))
            if node == len(children):
                children.append({})
        ends[node] = i
    stack = [(0, set(children[0].values()))]
    if 0 in ends:  # the empty word
        yield from ((ends[0], ends[b]) for b in children[0].values() if b in ends)
    while stack:
        node, active = stack.pop()
        around = set(children[node].values())
        around.add(node)
        by_letter: dict[str, list[int]] = {}
        for b in active:
            for c in children[b].keys() & children[node].keys():
                by_letter.setdefault(c, []).append(children[b][c])
        for c, child in children[node].items():
            near = around | set(children[child].values())
            near.update(by_letter.get(c, ()))
            near.discard(child)
            if child in ends:
                yield from ((ends[child], ends[b]) for b in near if b in ends)
            if children[child]:
                stack.append((child, near))


def _keyed(rows: DataFrame) -> DataFrame:
    """rows (word, size, head, tail) with the key of their partition."""
    word, ends = F.col("word"), [F.col("head"), F.col("tail")]
    key = F.concat_ws("|", "size", *ends, F.left(word, ends[0]), F.right(word, ends[1]))
    return rows.withColumn("key", key)


def _between() -> Column:
    return F.char_length("word") - F.col("head") - F.col("tail")


def _dealt(rows: DataFrame) -> DataFrame:
    """Each row twice: with half of what is between added to the prefix, and the other half to the suffix."""
    free = F.col("size") - F.col("head") - F.col("tail")
    more = F.ceil(free / 2).cast("int")
    ways = F.array(F.struct((F.col("head") + more).alias("head"), F.col("tail").alias("tail")), F.struct(F.col("head").alias("head"), (F.col("tail") + free - more).alias("tail")))
    return _keyed(rows.select("word", "size", F.explode(ways).alias("way")).select("word", "size", "way.head", "way.tail"))


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near: all pairs of words at distance one, in both orders. words: a column of distinct words."""
    sizes = F.explode(F.array(F.char_length("word"), F.char_length("word") - 1))
    rows = words.select("word", sizes.alias("size")).where("size > 0").select("word", "size", F.lit(0).alias("head"), F.lit(0).alias("tail"))
    parts = []
    while True:
        rows = materialize(_dealt(rows), "parts")
        sums = rows.groupBy("key").agg(F.count("*").alias("members"), F.sum(_between()).alias("chars"), F.first(F.col("size") - F.col("head") - F.col("tail")).alias("free"))
        large = sums.where((F.col("members") > 1) & (F.col("chars") > PART_CHARS) & (F.col("free") > 1)).select("key")
        large = materialize(large, "large")
        n = large.count()
        if not n:
            parts.append(rows)
            break
        large = broadcast_if_small(large, n, BROADCAST_ROWS)
        parts.append(rows.join(large, "key", "left_anti").select(*rows.columns))
        rows = rows.join(large, "key", "left_semi").select(*rows.columns)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    groups = whole.groupBy("key").agg(F.first("size").alias("size"), F.first("head").alias("head"), F.first("tail").alias("tail"), F.collect_list("word").alias("words")).where(F.size("words") > 1)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = [], []
            for size, head, tail, own in zip(*(b.column(c).to_pylist() for c in ("size", "head", "tail", "words")), strict=True):
                for i, j in trie_pairs([w[head : len(w) - tail] for w in own]):
                    if len(own[i]) == size or len(own[j]) == size:  # two longer words meet elsewhere
                        left.append(own[i])
                        right.append(own[j])
            yield pa.RecordBatch.from_pydict({"word": left, "near": right}, pa.schema([("word", pa.string()), ("near", pa.string())]))

    return groups.select("size", "head", "tail", "words").mapInArrow(joined, "word string, near string").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form), a forest: each round doubles the steps that are taken."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = new.where("moved").limit(1).count()
        drop_table(forms.sparkSession, now)
        now = new.drop("moved")
        if not moved:
            return now


def variants(vocab: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n)."""
    vocab = materialize(vocab.select("word", "n"), "vocabulary")
    near = near_pairs(vocab).join(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))  # the largest count, then the least word
    found = near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    placed = vocab.join(found, "word", "left").withColumn("form_n", -F.col("best.less"))
    fits = F.col("form_n") >= FACTOR * F.col("n")
    placed = placed.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n"))
    placed = materialize(placed, "forms")
    ends = roots(placed.where("form IS NOT NULL"))
    return placed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_of_documents(docs: DataFrame) -> DataFrame:
    """What op11 returns: the variants among the words of documents that were read with damage."""
    return variants(vocabulary(docs))
