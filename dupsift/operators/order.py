"""Places and order statistics of a whole table without one task that sees all of it.

Places come from range partitions: each is sorted by itself, and the counts of those before it are its offset. Order statistics come from histograms that are
refined where the wanted ranks lie, so nothing is sorted or exchanged but counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import kept

#: Cells of a histogram; rows around a wanted rank that are few enough to be counted by value.
CELLS, FEW = 2_048, 4_096
_LOW = (1 << 33) - 1


def with_positions(df: DataFrame, *order: str | Column, name: str = "pos") -> DataFrame:
    """df with the place (from 0) of each row in the order; rows that tie come in any order. An empty table stays empty."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = kept(ranged, "ranged")  # where range partitions end is drawn anew whenever they are computed
    part = F.shiftright("_at", 33)
    counts = {r["p"]: r["n"] for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row for each partition
    offsets, total = [], 0
    for p in range(max(counts, default=0) + 1):
        offsets.append(total)
        total += counts.get(p, 0)
    offset = F.get(F.lit(offsets).cast("array<bigint>"), part.cast("int"))
    return ranged.withColumn(name, offset + F.col("_at").bitwiseAND(F.lit(_LOW))).drop("_at")


def running_sums(df: DataFrame, value: str, *order: str | Column, name: str = "before") -> DataFrame:
    """df with the sum of `value` over all rows before each in the order. Sums within range partitions are windows; the partitions' sums are the offsets."""
    from pyspark.sql import Window

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_at", 33)
    sums = {r["p"]: r["s"] for r in ranged.groupBy(part.alias("p")).agg(F.sum(value).alias("s")).collect()}  # a row for each partition
    offsets, total = [], 0
    for p in range(max(sums, default=0) + 1):
        offsets.append(total)
        total += sums.get(p) or 0
    offset = F.get(F.lit(offsets).cast(f"array<{'double' if isinstance(total, float) else 'bigint'}>"), part.cast("int"))
    w = Window.partitionBy(part).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn(name, offset + F.coalesce(F.sum(value).over(w), F.lit(0))).drop("_at")


def order_statistics(df: DataFrame, ranks: dict[object, list[int]], by: str = "stratum", value: str = "value") -> dict[tuple[object, int], float]:
    """The value at each wanted rank (from 0) of each stratum of df (by, value; both without nulls), exactly. ranks: stratum to ranks, all within
    the stratum. Every pass counts, for each interval that still holds a wanted rank, the rows in each of CELLS cells, and keeps the cell with the rank; intervals
    of few rows are counted by value. A pass is one aggregation of the table; a few do."""
    spark = df.sparkSession
    slim = df.select(F.col(by).alias("_s"), F.col(value).cast("double").alias("_v"))
    ends = {r["_s"]: (r["a"], r["b"], r["n"]) for r in slim.groupBy("_s").agg(F.min("_v").alias("a"), F.max("_v").alias("b"), F.count("*").alias("n")).collect()}  # a row for each stratum
    # Wanted (stratum, rank) to (low, high, rows before, rows within).
    open_ = {(s, r): (ends[s][0], ends[s][1], 0, ends[s][2]) for s, rs in ranks.items() for r in rs}
    found: dict[tuple[object, int], float] = {}
    schema = df.select(F.col(by).alias("_s")).schema.add("lo", "double").add("hi", "double").add("few", "boolean")
    while True:
        for key, (lo, hi, _, _) in list(open_.items()):
            if lo == hi:
                found[key] = lo
                del open_[key]
        if not open_:
            return found
        intervals = {(s, lo, hi): n <= FEW for (s, _), (lo, hi, _, n) in open_.items()}
        table = F.broadcast(spark.createDataFrame([(*k, few) for k, few in intervals.items()], schema))  # as many rows as ranks at most
        inside = slim.join(table, "_s").where((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
        share = (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        cell = F.when(~F.col("few"), F.least(F.lit(CELLS - 1), F.floor(share * CELLS)))
        counts = inside.groupBy("_s", "lo", "hi", cell.alias("cell"), F.when(F.col("few"), F.col("_v")).alias("exact")).agg(F.count("*").alias("n"), F.min("_v").alias("a"), F.max("_v").alias("b"))
        cells: dict[tuple, list] = {}
        for r in counts.collect():  # CELLS or FEW rows for each interval at most
            cells.setdefault((r["_s"], r["lo"], r["hi"]), []).append((r["a"], r["b"], r["n"]))
        for key, (lo, hi, before, _) in open_.items():
            for a, b, n in sorted(cells[key[0], lo, hi]):
                if key[1] < before + n:
                    open_[key] = (a, b, before, n)
                    break
                before += n


def quantiles(df: DataFrame, columns: list[str], points: list[float]) -> dict[str, list[float] | None]:
    """Per column its quantiles with linear interpolation, exactly; None for a column without values."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("stratum"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.*").where("value IS NOT NULL")
    sizes = {r["stratum"]: r["n"] for r in rows.groupBy("stratum").agg(F.count("*").alias("n")).collect()}  # a row for each column
    places = {c: [(n - 1) * p for p in points] for c, n in sizes.items()}
    found = order_statistics(rows, {c: sorted({int(x) for x in at} | {min(int(x) + 1, sizes[c] - 1) for x in at}) for c, at in places.items()})
    out: dict[str, list[float] | None] = {}
    for c in columns:
        at = places.get(c)
        out[c] = None if at is None else [found[c, int(x)] + (x - int(x)) * (found[c, min(int(x) + 1, sizes[c] - 1)] - found[c, int(x)]) for x in at]
    return out


def evenly_spaced(df: DataFrame, most: int, *order: str) -> DataFrame:
    """At most `most` rows at evenly spaced places of the order, the first and the last among them (of one only the first): places floor(i * (n - 1) / (most - 1)). With the row's pos."""
    placed = kept(with_positions(df, *order), "placed")
    n = placed.count()
    chosen = min(most, n)
    if chosen <= 1:
        return placed.where(F.col("pos") < chosen)
    # A place is chosen if it is the rounded one of the i that it would have.
    i = F.ceil(F.col("pos") * F.lit(chosen - 1) / F.lit(float(n - 1)))
    exact = lambda i: F.floor(i * F.lit(n - 1) / F.lit(float(chosen - 1)))
    return placed.where((exact(i) == F.col("pos")) & (i < chosen))
