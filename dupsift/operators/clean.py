"""Cleaning, imputing, scaling, binning, vocabulary and balanced sampling of wide numeric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import bin_of, safe_name
from ..storage import kept
from . import order

# Labels with a damaged or long dash, and what they become.
LABEL_REPLACEMENTS = {
    "Web Attack � Brute Force": "Web Attack - Brute Force",
    "Web Attack � Sql Injection": "Web Attack - Sql Injection",
    "Web Attack � XSS": "Web Attack - XSS",
    "Web Attack – Brute Force": "Web Attack - Brute Force",
    "Web Attack – Sql Injection": "Web Attack - Sql Injection",
    "Web Attack – XSS": "Web Attack - XSS",
}
# The features that make token sequences, by preference.
PREFERRED_FEATURES = [
    "Destination Port",
    "Flow Duration",
    "Total Fwd Packets",
    "Total Backward Packets",
    "Total Length of Fwd Packets",
    "Total Length of Bwd Packets",
    "Flow Bytes/s",
    "Flow Packets/s",
    "Packet Length Mean",
    "Packet Length Std",
    "SYN Flag Count",
    "PSH Flag Count",
    "ACK Flag Count",
    "Down/Up Ratio",
    "Average Packet Size",
    "Init_Win_bytes_forward",
    "Init_Win_bytes_backward",
    "Active Mean",
    "Idle Mean",
]
PAD, OOV = 0, 1


def normalize_label(label: Column, replacements: dict[str, str] = LABEL_REPLACEMENTS) -> Column:
    trimmed = F.trim(label)
    known = F.create_map(*[F.lit(x) for kv in replacements.items() for x in kv])
    return F.coalesce(F.try_element_at(known, trimmed), trimmed)


def to_number(x: Column) -> Column:
    """As double; null for junk, NaN and infinities."""
    d = x.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def quantiles(df: DataFrame, columns: list[str], points: list[float], accuracy: int | None = None) -> dict[str, list[float] | None]:
    """Per column its quantiles. Exact, by linear interpolation between order statistics (see `order`); with `accuracy` by a sketch of that size, in one pass."""
    if not accuracy:
        return order.quantiles(df, columns, points)
    row = df.agg(*[F.percentile_approx(c, F.lit(points), F.lit(accuracy)).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns}


def impute_median(df: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    """Nulls of the columns become the column's median, 0 where it has no value."""
    found = quantiles(df, columns, [0.5], accuracy)
    return df.withColumns({c: F.coalesce(c, F.lit(float(found[c][0]) if found[c] else 0.0)) for c in columns})


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, has_two (whether it isn't constant): by least and greatest value, one pass without a distinct."""
    row = df.agg(*[F.struct(F.min(c).alias("a"), F.max(c).alias("b")).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).a != F.col(c).b, F.lit(False)).alias("kept")) for c in columns])).alias("x")).select("x.*")


def drop_constant(df: DataFrame, columns: list[str]) -> DataFrame:
    gone = [r["feature"] for r in distinct_counts(df, columns).where("NOT kept").collect()]  # a row for each column
    return df.drop(*gone)


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation, the deviation 1 where it is 0."""
    row = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).first()
    return df.withColumns({c: (F.col(c) - F.lit(row[c]["m"])) / F.lit(row[c]["s"] or 1.0) for c in columns})


def preprocessor(df: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    """feature, median, mean, deviation, kept: what imputing and scaling take from a table (mean and deviation after imputing; kept: not constant)."""
    found = quantiles(df, columns, [0.5], accuracy)
    filled = impute_median(df, columns, accuracy)
    row = filled.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s"), (F.min(c) < F.max(c)).alias("kept")).alias(c) for c in columns]).first()
    rows = [(c, float(found[c][0]) if found[c] else 0.0, row[c]["m"], row[c]["s"], bool(row[c]["kept"])) for c in columns]
    return df.sparkSession.createDataFrame(rows, "feature string, median double, mean double, deviation double, kept boolean")


def bin_edges(df: DataFrame, columns: list[str], bins: int = 8, accuracy: int | None = None) -> dict[str, list[float]]:
    """Strictly rising quantile edges; one value v gives [v, v + 1], none gives [0, 1]."""
    found = quantiles(df, columns, [i / bins for i in range(bins + 1)], accuracy)
    out = {}
    for c in columns:
        edges = sorted(set(found[c] or []))
        out[c] = edges if len(edges) > 1 else [edges[0], edges[0] + 1] if edges else [0.0, 1.0]
    return out


def sequence_features(columns: list[str], preferred: list[str] = PREFERRED_FEATURES) -> list[str]:
    """The preferred columns there are; with fewer than 12 (or all) of them, others in order up to 16."""
    chosen = [c for c in preferred if c in columns]
    if len(chosen) < min(12, len(columns)):
        chosen += [c for c in columns if c not in chosen][: max(1, 16 - len(chosen))]
    return chosen


def bin_tokens(label: Column, source: Column, edges: dict[str, list[float]]) -> Column:
    """label=, source= and for each feature name=bin_i."""
    own = [F.concat(F.lit(safe_name(c) + "=bin_"), bin_of(F.col(c), F.lit([float(x) for x in e])).cast("string")) for c, e in edges.items()]
    return F.array(F.concat(F.lit("label="), normalize_label(label)), F.concat(F.lit("source="), F.replace(source, F.lit(" "), F.lit("_"))), *own)


def vocabulary(sequences: DataFrame, col: str = "tokens") -> DataFrame:
    """token, token_id: sorted distinct tokens from 2 on, numbered by range partitions."""
    tokens = sequences.select(F.explode(col).alias("token")).distinct()
    return order.with_positions(tokens, "token").select("token", (F.col("pos") + 2).cast("int").alias("token_id"))


def encode(sequences: DataFrame, vocab: DataFrame, length: int, id_col: str = "id", col: str = "tokens") -> DataFrame:
    """id and ids: token ids, cut or padded behind to the length; unknown tokens are OOV."""
    coded = sequences.select(id_col, F.posexplode(F.slice(col, 1, length)).alias("pos", "token")).join(vocab, "token", "left")
    coded = coded.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("token_id", F.lit(OOV)).alias("t")))).alias("x"))
    ids = F.transform("x", lambda s: s.t)
    return coded.select(id_col, F.concat(ids, F.array_repeat(F.lit(PAD), F.lit(length) - F.size(ids))).alias("ids"))


def md5_order(prefix: str, *ids: str) -> Column:
    """A fixed pseudo-random order, the same in every engine."""
    return F.md5(F.concat_ws("|", F.lit(prefix), *[F.col(i).cast("string") for i in ids]))


def balanced_sample(df: DataFrame, most: int, label: str = "label", id_col: str = "id", seed: int = 42) -> DataFrame:
    """At most `most` rows: labels in order take ceil(most / labels) each while any are left to take, then leftovers fill up. All rows for most <= 0 or
    beyond the table."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    rows = sizes.orderBy(label).collect()  # a row for each label
    if most <= 0 or most >= sum(r["n"] for r in rows):
        return df
    quota, left, take = max(1, -(-most // len(rows))), most, {}
    for r in rows:
        take[r[label]] = min(quota, r["n"], left)
        left -= take[r[label]]
    placed = kept(df.withColumn("_o", F.conv(F.substring(md5_order(f"{seed}|sample", id_col), 1, 13), 16, 10).cast("double")).withColumn("_s", F.coalesce(F.col(label).cast("string"), F.lit("\0"))), "placed")
    wanted = {("\0" if k is None else str(k)): n for k, n in take.items() if n}
    ends = order.order_statistics(placed, {k: [n - 1] for k, n in wanted.items()}, "_s", "_o")
    limits = df.sparkSession.createDataFrame([(k, ends[k, n - 1]) for k, n in wanted.items()], "_s string, _end double")  # a row for each label
    placed = placed.join(F.broadcast(limits), "_s", "left")
    inside = F.coalesce(F.col("_o") <= F.col("_end"), F.lit(False))
    chosen = placed.where(inside)
    if left:
        chosen = chosen.union(placed.where(~inside).orderBy("_o", id_col).limit(left))
    return chosen.select(*df.columns)
