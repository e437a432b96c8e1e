"""Column functions over text and token arrays."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Ratios that a task remembers.
RATIOS = 200_000


def words(text: Column) -> Column:
    """Parts between white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def content_tokens(tokens: Column) -> Column:
    """The distinct tokens but those that tell label or source."""
    return F.array_distinct(F.filter(tokens, lambda t: ~(t.startswith("label=") | t.startswith("source="))))


def bigrams(tokens: Column) -> Column:
    """Distinct neighbours, joined by a blank; none for fewer than two tokens."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(tokens, 1, n), F.slice(tokens, 2, n), lambda a, b: F.concat_ws(" ", a, b)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def frequency_cosine(a: Column, b: Column) -> Column:
    """Cosine of the term frequencies of two token arrays; 0 where one is empty."""
    terms, n = F.array_distinct(F.array_intersect(a, b)), lambda x, t: F.size(F.filter(x, lambda y: y == t)).cast("double")
    square = lambda x: F.aggregate(F.array_distinct(x), F.lit(0.0), lambda s, t: s + n(x, t) * n(x, t))
    top = F.aggregate(terms, F.lit(0.0), lambda s, t: s + n(a, t) * n(b, t))
    return F.coalesce(F.try_divide(top, F.sqrt(square(a)) * F.sqrt(square(b))), F.lit(0.0))


def bin_of(x: Column, edges: Column) -> Column:
    """0 up to the first edge, the last bin from the last edge on, else by the inner edges; an edge belongs to the bin above it."""
    bins = F.size(edges) - 1
    inside = F.size(F.filter(F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0))), lambda e: x >= e))
    return F.when(x <= F.element_at(edges, 1), 0).when(x >= F.element_at(edges, -1), bins - 1).otherwise(inside)


def frame_indexes(frames: Column, vocabulary: list[str], length: int) -> Column:
    """Places (from 1) of the frames in a vocabulary, 0 for those that it lacks; cut or padded behind with 0 to the length. For a few frames; `clean.encode` joins large vocabularies."""
    places = F.transform(F.slice(frames, 1, length), lambda f: F.array_position(F.lit(vocabulary), f).cast("int"))
    return F.concat(places, F.array_repeat(F.lit(0), F.lit(length) - F.size(places)))


def safe_name(feature: str) -> str:
    return "".join("_" if c in " /." else c for c in feature.lower())


def floor_bin(s: Column, bins: int = 10) -> Column:
    """floor(bins * s), kept within the bins."""
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(s * bins))).cast("int")


def right_closed_bin(s: Column, bins: int = 10) -> Column:
    """Bins (a, b], the first one with its lower end."""
    return F.greatest(F.lit(0), F.ceil(s * bins) - 1).cast("int")


def _ratio(a: str, b: str, known: dict[tuple[str, str], float]) -> float:
    """The ratio depends on which characters are equal only, so pairs that differ by a renaming of characters share it. known: ratios by renamed pairs, RATIOS at most."""
    names = {ord(c): i for i, c in enumerate(dict.fromkeys(a + b))}
    key = (a.translate(names), b.translate(names))
    found = known.get(key)
    if found is None:
        found = SequenceMatcher(None, *key).ratio()
        if len(known) >= RATIOS:
            known.clear()
        known[key] = found
    return found


@F.pandas_udf(DoubleType())
def sequence_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The matching-blocks ratio of two strings as Python's difflib defines it, its treatment of frequent characters included."""
    known: dict[tuple[str, str], float] = {}
    for a, b in batches:
        yield pd.Series([_ratio(x or "", y or "", known) for x, y in zip(a, b, strict=True)], dtype="float64")
