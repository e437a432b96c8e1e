"""Benchmark decontamination by template canonicalisation, with DataFrame operations only.

Numbers, units after numbers and names (capitalised words; a run of them, whatever marks are between, is one name) become typed placeholders; what
remains is a template of lower-case words. Every window of WINDOW template words of a document is hashed and joined with the windows of the benchmark's
items. An item has two templates, one with its names as placeholders and one with its names as words, for copies in lower case; a document has the first. A document and an
item with enough matching windows on one diagonal, or on the diagonals within BAND of one (words put in or left out), are then compared slot by slot,
each slot on the nearest diagonal with a matching window over it: the value that an item has in a slot must go to one value in
the document wherever it recurs. A name at an item's first or last place may run on into the text around it: of a longer run only the item's end of it
is compared, and if that differs the slot says nothing. So a question with other numbers or names, put in consistently, is found, and text that
merely has the same shape with contradictory fillings isn't. Windows of which less than half are words say little: they don't count for an item, so
a table of numbers isn't every other table.

Each text is read once: its windows are looked up in the set of the benchmark's, a literal of the plan, and only texts with a hit go on. A benchmark with more
than LITERALS windows is joined instead, broadcast up to BROADCAST_ROWS counted rows and shuffled beyond.

Null or empty text has no words; texts of any length are read whole; an empty table gives no rows. Items with fewer words than WINDOW match as one window of their own length; items
with fewer than LEAST_WORDS words, which every text may have, match nothing. Rows with one doc_id and one text are judged alike. A null doc_id is judged as any other.
Extra columns, whatever their names, stay in `remove` and are dropped in `contaminations`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, without

WINDOW, LEAST_WORDS, COVERED, BAND, LITERALS, BROADCAST_ROWS = 8, 3, 0.6, 3, 50_000, 500_000
# Units that count as such after a number.
UNITS = "km cm mm kg mg lb lbs oz ml hours hour minutes minute seconds second days day weeks week months month years year miles mile meters metres feet inches dollars euros pounds cents percent degrees".split()
#: Placeholders of a number, a unit and a name, and a mark after a slot's value: private characters, so no word has them.
N, U, P, END = "\ue000", "\ue001", "\ue002", "\ue003"
_NUMBER, _UNIT = r"\p{N}++(?:[.,:/]\p{N}++)*+%?", rf"({'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])"
# Possessive groups: others are recursive, and a long run would overflow the stack.
_CAPITALISED = r"\p{Ll}++(?![\p{L}\p{N}])"
_NAME = rf"\p{{Lu}}(?<![\p{{L}}\p{{N}}]\p{{Lu}}){_CAPITALISED}(?:[^\p{{L}}\p{{N}}{N}{U}{P}{END}]{{1,3}}\p{{Lu}}{_CAPITALISED})*+"


def _words(text: Column, names: bool) -> Column:
    """The template: lower-case words and placeholders; with names, those are placeholders too."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), _NUMBER, N)
    out = F.regexp_replace(out, f"{N} {_UNIT}", f"{N} {U}")
    out = F.regexp_replace(out, _NAME, P) if names else out
    return F.regexp_extract_all(F.lower(out), F.lit(rf"[{N}{U}{P}]|[\p{{L}}\p{{N}}]+"), F.lit(0))


def _filled(text: Column, names: bool) -> Column:
    """The template word for word, with the value behind each placeholder."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), _NUMBER, f"{N}$0{END}")
    out = F.regexp_replace(out, f"{END} {_UNIT}", f"{END} {U}$1{END}")
    out = F.regexp_replace(out, _NAME, f"{P}$0{END}") if names else out
    return F.regexp_extract_all(F.lower(out), F.lit(rf"[{N}{U}{P}][^{END}]*|[\p{{L}}\p{{N}}]+"), F.lit(0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(words: Column, size: int) -> Column:
    """Hashes of all windows of `size` words (two at least): of two words, then of two windows, which may overlap."""

    def pairs(x: Column, step: int) -> Column:
        return F.zip_with(x, F.slice(x, F.lit(step + 1), F.size(x)), lambda a, b: F.xxhash64(a, b))

    def grow(x: Column, width: int) -> Column:
        if width == size:
            return x
        step = min(width, size - width)
        return _let(pairs(x, step), lambda y: grow(y, width + step))

    return F.slice(grow(words, 1), F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(0)))


def _placeholder(word: Column) -> Column:
    return F.substring(word, 1, 1).isin(N, U, P)


def _same_at_edge() -> Column:
    """Of the columns item_value, doc_value, ipos and last: null but for a name at an edge of the item that is longer in the document; then whether it has the item's words at its inner end."""
    item, doc = (F.split(F.substring(c, 2, 1 << 20), r"[^\p{L}\p{N}]+") for c in ("item_value", "doc_value"))
    longer = F.startswith("item_value", F.lit(P)) & (F.size(doc) > F.size(item))
    first = (F.col("ipos") == 0) & (F.slice(doc, -F.size(item), F.size(item)) == item)
    last = (F.col("ipos") == F.col("last")) & (F.slice(doc, F.lit(1), F.size(item)) == item)
    return F.when(longer & ((F.col("ipos") == 0) | (F.col("ipos") == F.col("last"))), first | last)


def _item_windows(benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Items (uid, item_id, text) and their windows (uid, names, size, total, ipos, w); total: windows of the item's template that count."""
    items = benchmark.select("item_id", "text").withColumn("uid", F.xxhash64("item_id", "text")).dropDuplicates(["uid"])
    items = materialize(items.withColumn("plain", _words(F.col("text"), False)).where(F.size("plain") >= LEAST_WORDS), "items")
    named = items.select("uid", F.lit(True).alias("names"), _words(F.col("text"), True).alias("words"), "plain").where((F.size("words") >= LEAST_WORDS) & (F.col("words") != F.col("plain")))
    views = named.drop("plain").union(items.select("uid", F.lit(False).alias("names"), F.col("plain").alias("words")))
    views = materialize(views.withColumn("size", F.least(F.size("words"), F.lit(window))), "views")
    out = None
    for r in views.select("size").distinct().orderBy("size").collect():  # `window` numbers at most
        size = r["size"]
        each = views.where(F.col("size") == size).select("uid", "names", "size", "words", F.posexplode(_windows(F.col("words"), size)).alias("ipos", "w"))
        own = F.filter(F.slice("words", F.col("ipos") + 1, F.lit(size)), lambda x: ~_placeholder(x))
        each = each.where(2 * F.size(own) >= size).select("uid", "names", "size", "ipos", "w")
        out = each if out is None else out.union(each)
    if out is None:
        out = views.select("uid", "names", "size", F.lit(0).alias("ipos"), F.lit(0).cast("bigint").alias("w"))
    out = materialize(out, "windows")
    totals = out.groupBy("uid", "names").agg(F.count("*").alias("total"))
    return items, materialize(out.join(broadcast_if_small(totals, items.count(), BROADCAST_ROWS), ["uid", "names"]), "grams")


def _has_window(words: Column, size: int, wanted: list[int]) -> Column:
    return _let(words, lambda own: F.exists(_windows(own, size), lambda x: x.isin(wanted)))


def _candidates(docs: DataFrame, grams: DataFrame, n_grams: int) -> DataFrame:
    """doc_id, h, text of the documents that have a window of the benchmark, once each."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    sizes = [r["size"] for r in grams.select("size").distinct().orderBy("size").collect()]
    words = _words(F.col("text"), True)
    if n_grams <= LITERALS:
        hit = F.lit(False)
        for size in sizes:
            wanted = [r["w"] for r in grams.where(F.col("size") == size).select("w").distinct().collect()]
            hit = hit | _has_window(words, size, wanted)
        return keyed.where(hit).dropDuplicates(["doc_id", "h"])
    found = None
    for size in sizes:
        each = keyed.select("doc_id", "h", F.explode(_windows(words, size)).alias("w"))
        found = each if found is None else found.union(each)
    side = broadcast_if_small(grams.select("w").distinct(), n_grams, BROADCAST_ROWS)
    found = materialize(found.join(side, "w", "left_semi").select("doc_id", "h").distinct(), "found")
    right = broadcast_if_small(found, found.count(), BROADCAST_ROWS)
    return keyed.join(right, (keyed["h"] == right["h"]) & keyed["doc_id"].eqNullSafe(right["doc_id"]), "left_semi").dropDuplicates(["doc_id", "h"])


def contaminations(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, covered: float = COVERED) -> DataFrame:
    """doc_id, h (hash of the text), item_id, coverage, kind: 'exact' where all words of the item are there in order (others may be between them), else 'reparameterised'."""
    items, grams = _item_windows(benchmark, window)
    n_grams = grams.count()
    candidates = materialize(_candidates(docs, grams, n_grams), "candidates")
    words = candidates.select("doc_id", "h", _words(F.col("text"), True).alias("words"))
    exploded = None
    for r in grams.select("size").distinct().orderBy("size").collect():
        each = words.select("doc_id", "h", F.posexplode(_windows(F.col("words"), r["size"])).alias("dpos", "w"))
        exploded = each if exploded is None else exploded.union(each)
    if exploded is None:
        exploded = words.select("doc_id", "h", F.lit(0).alias("dpos"), F.lit(0).cast("bigint").alias("w"))
    # One diagonal: the same offset between the places in the document and in the item.
    item = ["uid", "names", "size", "total"]
    diagonals = exploded.join(broadcast_if_small(grams, n_grams, BROADCAST_ROWS), "w").groupBy("doc_id", "h", *item, (F.col("dpos") - F.col("ipos")).alias("shift")).agg(F.collect_set("ipos").alias("at"))
    diagonals = materialize(diagonals, "diagonals")
    part = F.struct(F.abs(F.col("shift") - F.col("centre")).alias("off"), "shift", "at")
    single = diagonals.withColumn("centre", F.col("shift")).select("doc_id", "h", *item, "centre", F.lit(False).alias("wide"), F.array(part).alias("parts"))
    band = (
        diagonals.withColumn("centre", F.explode(F.sequence(F.col("shift") - BAND, F.col("shift") + BAND)))
        .groupBy("doc_id", "h", *item, "centre")
        .agg(F.collect_list(part).alias("parts"))  # 2 BAND + 1 at most
        .where((F.size("parts") > 1) & F.exists("parts", lambda x: x.off == 0))
        .select("doc_id", "h", *item, "centre", F.lit(True).alias("wide"), "parts")
    )
    matched = F.size(F.array_distinct(F.flatten(F.transform("parts", lambda x: x["at"]))))
    hits = single.union(band).withColumn("coverage", matched / F.col("total")).where(F.col("coverage") >= covered)
    hits = materialize(hits, "hits")

    def slots(rows: DataFrame, keys: list[str], pos: str, value: str, names: bool) -> DataFrame:
        all_ = rows.select(*keys, _filled(F.col("text"), names).alias("all_"))
        out = all_.select(*keys, F.posexplode("all_").alias(pos, value), (F.size("all_") - 1).alias("last"))
        return out.where(_placeholder(F.col(value)))

    found = hits.select("doc_id", "h").distinct()
    chosen = candidates.join(found.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h")), (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    doc_slots = slots(chosen, ["doc_id", "h"], "dpos", "doc_value", True).withColumnRenamed("doc_id", "_d").drop("last")
    item_slots = slots(items, ["uid"], "ipos", "item_value", True).withColumn("names", F.lit(True)).union(slots(items, ["uid"], "ipos", "item_value", False).withColumn("names", F.lit(False)))
    keys = ["doc_id", "h", "uid", "names", "centre", "wide"]
    over = lambda x: F.exists(x["at"], lambda i: F.col("ipos").between(i, i + F.col("size") - 1))
    placed = hits.join(item_slots, ["uid", "names"])
    placed = placed.withColumn("nearest", F.array_min(F.transform(F.filter("parts", over), lambda x: F.struct(x.off.alias("off"), x["shift"].alias("shift"))))).where("nearest IS NOT NULL")
    filled = (
        placed.withColumn("dpos", F.col("ipos") + F.col("nearest.shift"))
        .join(doc_slots, ["h", "dpos"])
        .where(F.col("doc_id").eqNullSafe(F.col("_d")))
        .withColumn("same", _same_at_edge())
        .withColumn("told", F.when(F.col("same"), F.col("item_value")).when(F.col("same").isNull(), F.col("doc_value")))
        .groupBy(*keys, "item_value")
        .agg(F.count_distinct("told").alias("values"))
        .groupBy(*keys)
        .agg(F.max("values").alias("values"))
        .select(*(F.col(k).alias(f"_{k}") for k in keys), "values")
    )
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k).eqNullSafe(F.col(f"_{k}")) if k == "doc_id" else F.col(k) == F.col(f"_{k}"))
    judged = hits.join(filled, same, "left").where(F.coalesce("values", F.lit(1)) <= 1).select("doc_id", "h", "uid", "names", "centre", "coverage").distinct()
    # Word for word: all words of the item follow each other, perhaps with others between, where the document has it.
    plain = lambda text: F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    own = [items.select("uid", "item_id", F.lit(n).alias("names"), F.size(_words(F.col("text"), n)).alias("long"), plain(F.col("text")).alias("item_words")) for n in (True, False)]
    doc = chosen.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), _filled(F.col("text"), True).alias("filled"))
    placed = judged.join(own[0].union(own[1]), ["uid", "names"]).join(doc, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    first = F.greatest(F.col("centre") - BAND, F.lit(0))
    around = plain(F.array_join(F.slice("filled", first + 1, F.greatest(F.lit(0), F.col("centre") + F.col("long") + BAND - first)), " "))
    reached = F.aggregate(around, F.lit(0), lambda i, w: F.when(F.get("item_words", i) == w, i + 1).otherwise(i))
    placed = placed.select("doc_id", "h", "item_id", "coverage", (reached == F.size("item_words")).alias("whole"))
    return placed.groupBy("doc_id", "h", "item_id").agg(F.max("coverage").alias("coverage"), F.when(F.max("whole"), "exact").otherwise("reparameterised").alias("kind"))


def verdicts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per contaminated document: doc_id, n_items, item_ids (in order), best coverage, whether an item is there word for word."""
    found = contaminations(docs, benchmark)
    return found.groupBy("doc_id", "h").agg(
        F.count_distinct("item_id").alias("n_items"),
        F.array_join(F.transform(F.array_sort(F.collect_set("item_id")), lambda x: x.cast("string")), ",").alias("item_ids"),
        F.round(F.max("coverage"), 6).alias("coverage"),
        F.max((F.col("kind") == "exact").cast("int")).alias("exact"),
    ).drop("h")


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated documents, columns as they are."""
    found = materialize(contaminations(docs.select("doc_id", "text"), benchmark).select("doc_id", "h").distinct(), "found")
    return without(docs, found, BROADCAST_ROWS)
