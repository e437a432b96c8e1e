"""Evaluation: confusion counts, threshold sweeps, correlation, calibration, bit statistics, retrieval measures."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions import vectors as V
from ..storage import kept
from .order import evenly_spaced, running_sums


def share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def with_rates(df: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall, f1 (0 where undefined) to tp, tn, fp, fn."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    p, r = share(tp, tp + fp), share(tp, tp + fn)
    return df.withColumns({"accuracy": F.round(share(tp + tn, tp + tn + fp + fn), 6), "precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(share(2 * p * r, p + r), 6)})


def confusion(scored: DataFrame, threshold: float, by: list[str] = []) -> DataFrame:  # noqa: B006
    """From score and truth (0/1): tp, tn, fp, fn and rates; predicted where score >= threshold."""
    yes, true = F.col("score") >= threshold, F.col("truth") == 1
    counts = [F.count_if(yes & true).alias("tp"), F.count_if(~yes & ~true).alias("tn"), F.count_if(yes & ~true).alias("fp"), F.count_if(~yes & true).alias("fn")]
    return with_rates(scored.groupBy(*by).agg(*counts) if by else scored.agg(*counts))


def sweep(scored: DataFrame, thresholds: list[float], by: list[str] = []) -> DataFrame:  # noqa: B006
    """The measures at every threshold. Rows are first counted by the number of thresholds that they reach, so the data are read and shuffled once
    however many thresholds there are."""
    levels = F.lit(thresholds)
    reached = scored.select(*by, "truth", F.size(F.filter(levels, lambda t: F.col("score") >= t)).alias("reached"))
    cells = reached.groupBy(*by, "reached").agg(F.count_if(F.col("truth") == 1).alias("pos"), F.count_if(F.col("truth") != 1).alias("neg"))
    each = cells.select("*", F.posexplode(levels).alias("i", "threshold"))
    yes = F.col("reached") > F.col("i")
    pick = lambda c, on: F.sum(F.when(on, F.col(c)).otherwise(0))
    return with_rates(each.groupBy(*by, "threshold").agg(pick("pos", yes).alias("tp"), pick("neg", ~yes).alias("tn"), pick("neg", yes).alias("fp"), pick("pos", ~yes).alias("fn")))


def best_threshold(scored: DataFrame, thresholds: list[float], by: list[str] = []) -> DataFrame:  # noqa: B006
    """Of the sweep the row with the highest f1, ties to higher recall, then to the lowest threshold."""
    w = Window.partitionBy(*by).orderBy(F.desc("f1"), F.desc("recall"), "threshold")
    return sweep(scored, thresholds, by).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def spread(start: float, stop: float, n: int) -> list[float]:
    return [round(start + (stop - start) * i / (n - 1), 6) for i in range(n)]


DEFAULT_THRESHOLDS, SIMHASH_THRESHOLDS = spread(0.1, 0.95, 18), spread(0.5, 0.98, 17)


def average_ranks(df: DataFrame, col: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """The average rank of each distinct value (within `by`): by, value, rank, n. Ranks are running sums over distinct values, by range partitions."""
    counts = df.groupBy(*by, F.col(col).alias("value")).agg(F.count("*").alias("n"))
    summed = running_sums(counts, "n", *by, "value")
    if by:  # a row for each group
        summed = summed.join(summed.groupBy(*by).agg(F.min("before").alias("_start")), by).withColumn("before", F.col("before") - F.col("_start"))
    return summed.select(*by, "value", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"), "n")


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return df.agg(F.round(F.coalesce(r, F.lit(0.0)), 6).alias("pearson"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of average ranks; values should be rounded, as ranks are made over distinct values."""
    rx, ry = average_ranks(df, x), average_ranks(df, y)
    ranked = df.join(rx.select(F.col("value").alias(x), F.col("rank").alias("_rx")), x).join(ry.select(F.col("value").alias(y), F.col("rank").alias("_ry")), y)
    return pearson(ranked, "_rx", "_ry").withColumnRenamed("pearson", "spearman")


#: Rows that one block of values should hold, and blocks at most.
BLOCK_ROWS, MOST_BLOCKS = 200_000, 256


def concordance(a: np.ndarray, v: np.ndarray, w: np.ndarray) -> float:
    """Sum over pairs with a < a' of sign(v' - v) w w'. Halves of the ranks of a are compared level by level, each level by one sort."""
    rank = np.unique(a, return_inverse=True)[1]
    v = np.unique(v, return_inverse=True)[1]
    total, level = 0.0, 0
    while rank.max(initial=0) >> level:
        group, right = rank >> (level + 1), (rank >> level) & 1 == 1
        order = np.lexsort((v, group))
        g, x, left = group[order], v[order], np.where(right[order], 0.0, w[order])
        sums = np.r_[0.0, np.cumsum(left)]
        key = g * (int(v.max()) + 1) + x
        below, upto = sums[np.searchsorted(key, key, "left")], sums[np.searchsorted(key, key, "right")]
        first, last = sums[np.searchsorted(g, g, "left")], sums[np.searchsorted(g, g, "right")]
        own = right[order]
        total += float((w[order] * ((below - first) - (last - upto)))[own].sum())
        level += 1
    return total


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """tau-b, exactly, whatever the number of distinct values. Values of x and of y are cut into blocks of about BLOCK_ROWS rows by running sums; a value with more is a block of its own.
    Pairs that differ in both blocks come from the table of block counts (at most (2 * MOST_BLOCKS)^2 cells); pairs within a block of x, or of y, are compared in a task for each block."""
    cells = kept(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("n")), "cells")
    rows = cells.agg(F.sum("n")).first()[0] or 0
    size = max(BLOCK_ROWS, -(-rows // MOST_BLOCKS))

    def placed(c: str) -> DataFrame:
        summed = running_sums(cells.groupBy(c).agg(F.sum("n").alias("m")), "m", c)
        return kept(summed.select(c, "m", (2 * F.floor(F.col("before") / size) + (F.col("m") > size).cast("bigint")).alias(f"b{c}")), f"blocks_{c}")

    by_x, by_y = placed("x"), placed("y")
    both = kept(cells.join(by_x.drop("m"), "x").join(by_y.drop("m"), "y"), "placed")

    def compared(major: str) -> Callable[[pa.Table], pa.Table]:
        return lambda t: pa.table({"s": [concordance(*(t.column(c).to_numpy().astype(np.float64) for c in (major, "y", "n")))]})

    # A block of one value (odd) has no pairs of its own.
    within_x = both.where("bx % 2 = 0").groupBy("bx").applyInArrow(compared("x"), "s double")
    within_y = both.where("by % 2 = 0").groupBy("by").applyInArrow(compared("bx"), "s double")
    s = within_x.union(within_y).agg(F.sum("s")).first()[0] or 0.0
    counts = both.groupBy("bx", "by").agg(F.sum("n").alias("n")).collect()
    if counts:
        i, j = (np.unique([r[c] for r in counts], return_inverse=True)[1] for c in ("bx", "by"))
        table = np.zeros((i.max() + 1, j.max() + 1))
        table[i, j] = [r["n"] for r in counts]
        below = np.zeros_like(table)  # counts in later blocks of x
        below[:-1] = np.cumsum(table[::-1], 0)[::-1][1:]
        sums = np.cumsum(below, 1)
        s += float((table * ((sums[:, -1:] - sums) - (sums - below))).sum())
    ties = [float(t.agg(F.sum(F.col("m").cast("double") * (F.col("m") - 1) / 2)).first()[0] or 0) for t in (by_x, by_y)]
    every = rows * (rows - 1) / 2
    scale = math.sqrt((every - ties[0]) * (every - ties[1]))
    return df.sparkSession.createDataFrame([(round(s / scale, 6) if scale else 0.0,)], "kendall_tau double")


def calibration(df: DataFrame, true: str = "true_sim", predicted: str = "pred_sim") -> DataFrame:
    """mae; count, means and gap for true in [0.4, 0.7) and true >= 0.8 (an empty band: 0, 0, 0, 1); the recommendation score."""
    t, p = F.col(true), F.col(predicted)
    band = {"mid": (t >= 0.4) & (t < 0.7), "high": t >= 0.8}
    aggs = [F.avg(F.abs(p - t)).alias("mae")]
    for n, on in band.items():
        aggs += [F.count_if(on).alias(f"{n}_count"), F.avg(F.when(on, t)).alias(f"{n}_true"), F.avg(F.when(on, p)).alias(f"{n}_pred")]
    out = df.agg(*aggs).withColumn("mae", F.coalesce("mae", F.lit(0.0)))
    for n in band:
        out = out.withColumn(f"{n}_gap", F.coalesce(F.abs(F.col(f"{n}_pred") - F.col(f"{n}_true")), F.lit(1.0)))
        out = out.withColumns({f"{n}_true": F.coalesce(f"{n}_true", F.lit(0.0)), f"{n}_pred": F.coalesce(f"{n}_pred", F.lit(0.0))})
    out = out.withColumn("recommendation", F.col("mae") + F.col("mid_gap") + F.col("high_gap"))
    return out.select(*[F.round(c, 6).alias(c) if kind == "double" else c for c, kind in out.dtypes])


def calibration_curve(df: DataFrame, right_closed: bool = False) -> DataFrame:
    """bin, n, mean_true, mean_pred for ten bins; left-closed bins leave out empty ones, right-closed ones keep them with nulls."""
    b = T.right_closed_bin(F.col("true_sim")) if right_closed else T.floor_bin(F.col("true_sim"))
    out = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("true_sim"), 6).alias("mean_true"), F.round(F.avg("pred_sim"), 6).alias("mean_pred"))
    if right_closed:
        bins = df.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
        out = bins.join(out, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out


def bit_stats(codes: DataFrame, bits: int) -> DataFrame:
    """bit, n, mean_value, positive_rate, entropy of ±1 codes (column code): one row of sums, then a row for each bit."""
    sums = codes.agg(F.count("*").alias("n"), *[F.sum((F.get("code", F.lit(i)) > 0).cast("bigint")).alias(f"b{i}") for i in range(bits)])
    each = sums.select("n", F.posexplode(F.array(*[F.col(f"b{i}") for i in range(bits)])).alias("bit", "ones"))
    p = F.col("ones") / F.col("n")
    h = -(p * F.log2(p + 1e-12) + (1 - p) * F.log2(1 - p + 1e-12))
    return each.select("bit", "n", F.round(2 * p - 1, 6).alias("mean_value"), F.round(p, 6).alias("positive_rate"), F.round(h, 6).alias("entropy"))


def collapse_warning(stats: DataFrame) -> DataFrame:
    """mean_entropy, low_bits (< 0.1), low_ratio, warning (mean < 0.3 or ratio > 0.25)."""
    one = stats.agg(F.round(F.avg("entropy"), 6).alias("mean_entropy"), F.count_if(F.col("entropy") < 0.1).alias("low_bits"), F.round(F.avg((F.col("entropy") < 0.1).cast("double")), 6).alias("low_ratio"))
    return one.withColumn("warning", ((F.col("mean_entropy") < 0.3) | (F.col("low_ratio") > 0.25)).cast("int"))


def precision_recall(scored: DataFrame, k: int, bands: int) -> DataFrame:
    """Per query q over rows (q, sim, candidate 0/1): n_candidates, precision (null without candidates), recall (null without true ones), f
    (0 where either is 0); true where the S-curve of sim is at least 0.5."""
    true = V.lsh_probability(F.col("sim"), k, bands) >= 0.5
    c = F.col("candidate") == 1
    return rates(scored.groupBy("q").agg(F.count_if(c).alias("n_candidates"), F.count_if(c & true).alias("hit"), F.count_if(true).alias("relevant")))


def rates(counts: DataFrame, *own: str) -> DataFrame:
    """Columns `own`, q, n_candidates, precision, recall and fscore of counted n_candidates, hit and relevant."""
    p, r = F.try_divide(F.col("hit").cast("double"), F.col("n_candidates").cast("double")), F.try_divide(F.col("hit").cast("double"), F.col("relevant").cast("double"))
    f = F.when(p.isNull() | r.isNull(), None).when((p == 0) | (r == 0), 0.0).otherwise(2 * p * r / (p + r))
    return counts.select(*own, "q", "n_candidates", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("fscore"))


def weakest_hit(scored: DataFrame, k: int, bands: int) -> DataFrame:
    """q, probability of the least similar candidate; null without candidates."""
    least = F.min(F.when(F.col("candidate") == 1, F.col("sim")))
    return probability(scored.groupBy("q").agg(least.alias("s")), k, bands)


def probability(least: DataFrame, k: int, bands: int) -> DataFrame:
    """q, probability of a similarity s; null where s is."""
    return least.select("q", F.round(F.when(F.col("s").isNotNull(), V.lsh_probability(F.col("s"), k, bands)), 6).alias("probability"))


def generalized_mrr(scored: DataFrame) -> DataFrame:
    """q, mrr: over candidates by similarity at place i with r the first place of their similarity among all rows: 1 if i > r else (i + 1) / (r + 1)."""
    everyone = Window.partitionBy("q").orderBy(F.desc("sim"))
    ranked = scored.withColumn("r", F.rank().over(everyone)).where("candidate = 1")
    ranked = ranked.withColumn("i", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "id")))
    score = F.when(F.col("i") > F.col("r"), 1.0).otherwise((F.col("i") + 1) / (F.col("r") + 1))
    return scored.select("q").distinct().join(ranked.groupBy("q").agg(F.round(F.avg(score), 6).alias("mrr")), "q", "left")


def recall_at_k(scored: DataFrame, orders: list[tuple[int, str]], k: int) -> DataFrame:
    """q, level, recall: at the first level (number, candidate column) with at least k candidates, the share of the k best candidate similarities that
    are among the k best of all (as multisets); level null and 0 where no level has k."""
    top = lambda on: F.slice(F.sort_array(F.collect_list(F.when(on, F.col("sim"))), asc=False), 1, k)
    best = Window.partitionBy("q").orderBy(F.desc("sim"), "id")
    truth = scored.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).groupBy("q").agg(top(F.lit(True)).alias("best"))
    out = truth
    for n, col in orders:
        w = Window.partitionBy("q").orderBy(F.desc("sim"), "id")
        own = scored.where(F.col(col) == 1).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).groupBy("q").agg(top(F.lit(True)).alias(f"c{n}"))
        out = out.join(own, "q", "left")
    return _recall(out, [n for n, _ in orders], k)


def recall_of_best(found: DataFrame, levels: list[int], k: int) -> DataFrame:
    """As `recall_at_k`, of rows (q, kind, sim): the k best of all rows (kind 0), and of each level's candidates (kind 1 and so on)."""
    of = lambda i: F.sort_array(F.collect_list(F.when(F.col("kind") == i, F.col("sim"))), asc=False)
    return _recall(found.groupBy("q").agg(of(0).alias("best"), *[of(i).alias(f"c{n}") for i, n in enumerate(levels, 1)]), levels, k)


def _recall(out: DataFrame, levels: list[int], k: int) -> DataFrame:
    """q, level, recall of the sorted lists best and c<level>."""
    level = F.coalesce(*[F.when(F.size(f"c{n}") >= k, F.lit(n)) for n in levels])
    chosen = F.coalesce(*[F.when(F.size(f"c{n}") >= k, F.col(f"c{n}")) for n in levels])
    # Both lists are sorted, so the multiset intersection counts, value by value, the lesser number.
    common = F.aggregate(F.array_distinct(F.col("best")), F.lit(0), lambda s, x: s + F.least(F.size(F.filter("best", lambda y: y == x)), F.size(F.filter(chosen, lambda y: y == x))))
    return out.select("q", level.alias("level"), F.round(F.coalesce(F.when(level.isNotNull(), common / F.lit(float(k))), F.lit(0.0)), 6).alias("recall"))


def retrieval_report(pairs: DataFrame, ks: list[int], by: str | None = None, most: int | None = None) -> DataFrame:
    """mrr, hit and precision at each k of candidate rankings from scored pairs (id_1, id_2, score, truth), taken both ways; queries are the
    ids with a true pair, at most `most` of them, evenly spaced; ties go to the smaller id. by: a column of methods, each with a row."""
    own = [by] if by else []
    both = pairs.select(*own, F.col("id_1").alias("q"), F.col("id_2").alias("id"), "score", "truth").union(pairs.select(*own, "id_2", "id_1", "score", "truth"))
    both = both.groupBy(*own, "q", "id").agg(F.max("score").alias("score"), F.max("truth").alias("truth"))
    asked = both.where("truth = 1").select("q").distinct()
    if most is not None:
        asked = evenly_spaced(asked, most, "q").select("q")
    ranked = both.join(asked, "q", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy(*own, "q").orderBy(F.desc("score"), "id")))
    true = F.col("truth") == 1
    per = ranked.groupBy(*own, "q").agg(F.min(F.when(true, F.col("n"))).alias("first"), *[F.count_if(true & (F.col("n") <= k)).alias(f"n{k}") for k in ks])
    aggs = [F.count("*").alias("queries"), F.round(F.avg(1 / F.col("first")), 6).alias("mrr")]
    for k in ks:
        aggs += [F.round(F.avg((F.col(f"n{k}") > 0).cast("double")), 6).alias(f"hit_at_{k}"), F.round(F.avg(F.col(f"n{k}") / k), 6).alias(f"precision_at_{k}")]
    return per.groupBy(by).agg(*aggs) if by else per.agg(*aggs)


def best_model(metrics: DataFrame) -> DataFrame:
    """The row with the best f1, recall, precision (nulls last)."""
    return metrics.orderBy(F.desc_nulls_last("f1"), F.desc_nulls_last("recall"), F.desc_nulls_last("precision"), "model").limit(1)
