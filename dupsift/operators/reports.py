"""Composite reports: diagnostics, long frames of several measures, comparisons of models, dashboard extras."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as T
from . import metrics


def true_neighbours(scored: DataFrame, n: int) -> DataFrame:
    """q, id, sim, place: the n most similar rows of each query, ties to the smaller id. scored: q, id, sim."""
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "id")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("q", "id", "sim", "place")


def _summary(on: Column, name: str) -> list[Column]:
    value = lambda c: F.when(on, F.col(c))
    return [F.count_if(on).alias(f"{name}_n"), F.avg(value("pred_sim")).alias(f"{name}_p"), F.median(value("pred_sim")).alias(f"{name}_m"), F.avg(value("true_sim")).alias(f"{name}_t")]


def diagnostics(codes: DataFrame, scored: DataFrame, bits: int) -> DataFrame:
    """diagnostic_type, group, name, count, value, mean_pred_sim, median_pred_sim, mean_true_sim: bit entropies, same and different labels, and
    ten right-closed bins (empty ones with nulls). Entropies clip at 1e-12. scored is read once."""
    stats = metrics.bit_stats(codes, bits)
    p = F.col("positive_rate")
    clipped = lambda x: F.log2(F.greatest(F.lit(1e-12), F.least(F.lit(1.0), x)))
    null = F.lit(None).cast("double")
    a = stats.select(F.lit("hash_bit_entropy").alias("diagnostic_type"), F.lit("bit").alias("group"), F.col("bit").cast("string").alias("name"), F.col("n").alias("count"), F.round(-(p * clipped(p) + (1 - p) * clipped(1 - p)), 6).alias("value"), null.alias("mean_pred_sim"), null.alias("median_pred_sim"), null.alias("mean_true_sim"))
    same = F.col("label_1") == F.col("label_2")
    parts = [("label_pair_pred_sim", g, g, on) for g, on in (("same_label", same), ("different_label", ~same))]
    parts += [("jaccard_bin_calibration", "jaccard_bin", str(i), T.right_closed_bin(F.col("true_sim")) == i) for i in range(10)]
    one = scored.agg(*[c for i, x in enumerate(parts) for c in _summary(x[3], f"x{i}")])
    rows = F.array(*[F.struct(F.lit(t).alias("diagnostic_type"), F.lit(g).alias("group"), F.lit(n).alias("name"), F.col(f"x{i}_n").alias("count"), F.round(f"x{i}_p", 6).alias("value"), F.round(f"x{i}_p", 6).alias("mean_pred_sim"), F.round(f"x{i}_m", 6).alias("median_pred_sim"), F.round(f"x{i}_t", 6).alias("mean_true_sim")) for i, (t, g, n, _) in enumerate(parts)])
    return a.unionByName(one.select(F.explode(rows).alias("r")).select("r.*"))


def long_frame(wide: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """A row for each key and measure."""
    return wide.unpivot(keys, measures, "metric", "similarity")


def delta(models: DataFrame, best: str, baseline: str, measure: str = "f1") -> DataFrame:
    """best, baseline and their difference in percent points, as one conditional aggregate."""
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col(measure)))
    return models.agg(F.round(pick(best), 6).alias("best"), F.round(pick(baseline), 6).alias("baseline"), F.round((pick(best) - pick(baseline)) * 100, 2).alias("delta_points"))


def label_of(candidate: Column, attack: Column, label: Column) -> Column:
    """The first that isn't blank: candidate label, attack type, label; else UNKNOWN."""
    return F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in (candidate, attack, label)], F.lit("UNKNOWN"))


def fallback_similarity(rank: Column) -> Column:
    """What a demonstration shows in place of a similarity, for ranks from 0. Not a measurement."""
    return F.greatest(F.lit(0.72), 0.96 - 0.03 * rank)


def fallback_hits(rank: Column) -> Column:
    return F.greatest(F.lit(1), 5 - rank)


def json_param(params: Column, name: str, default: str) -> Column:
    """A parameter of a JSON object as text; the default where it is missing, null or blank."""
    return F.coalesce(F.nullif(F.trim(F.get_json_object(params, f"$.{name}")), F.lit("")), F.lit(default))


def balance_loss(codes: DataFrame, col: str, dims: int) -> DataFrame:
    """Mean over dimensions of the squared mean: one row of sums."""
    means = codes.agg(*[F.avg(F.get(col, F.lit(i)).cast("double")).alias(f"d{i}") for i in range(dims)])
    return means.select(F.round(F.aggregate(F.array(*[F.pow(f"d{i}", F.lit(2)) for i in range(dims)]), F.lit(0.0), lambda a, x: a + x) / dims, 6).alias("balance_loss"))


def energies(v: Column) -> dict[str, Column]:
    """Diagnostics of one vector: sum of squares, absolute sum, cosine to the vector of ones."""
    total = lambda f: F.aggregate(v, F.lit(0.0), lambda a, x: a + f(x.cast("double")))
    square, plain = total(lambda x: x * x), total(lambda x: x)
    return {"energy": square, "abs_sum": total(F.abs), "cosine_to_ones": F.coalesce(F.try_divide(plain, F.sqrt(square * F.size(v))), F.lit(0.0))}


def selection(scored: DataFrame) -> DataFrame:
    """Per configuration (column config): pearson, spearman, mae, gap of the high band, score = pearson + spearman - mae - gap, best first; ties to the lower mae.
    A gap without pairs is 1."""

    def ranked(c: str) -> DataFrame:
        return metrics.average_ranks(scored, c, ["config"]).select("config", F.col("value").alias(c), F.col("rank").alias(f"{c}_rank"))

    def corr(x: str, y: str) -> Column:
        return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))

    t, p = F.col("true_sim"), F.col("pred_sim")
    high = t >= 0.8
    gap = F.coalesce(F.abs(F.avg(F.when(high, p)) - F.avg(F.when(high, t))), F.lit(1.0))
    rows = scored.join(ranked("true_sim"), ["config", "true_sim"]).join(ranked("pred_sim"), ["config", "pred_sim"])
    out = rows.groupBy("config").agg(corr("true_sim", "pred_sim").alias("pearson"), corr("true_sim_rank", "pred_sim_rank").alias("spearman"), F.avg(F.abs(p - t)).alias("mae"), gap.alias("gap"))
    out = out.select("config", *[F.round(c, 6).alias(c) for c in ("pearson", "spearman", "mae", "gap")], F.round(F.col("pearson") + F.col("spearman") - F.col("mae") - F.col("gap"), 6).alias("score"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "mae", "config")))  # a row for each configuration


def kendall_p_value(tau: float, n: int) -> float:
    """Two-sided, by the normal approximation without ties; approximate."""
    if n < 3:
        return 1.0
    z = 3 * abs(tau) * math.sqrt(n * (n - 1)) / math.sqrt(2 * (2 * n + 5))
    return math.erfc(z / math.sqrt(2))
