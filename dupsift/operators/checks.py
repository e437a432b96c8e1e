"""Validations of pair files and similarity columns; each is one aggregate and raises ValueError."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_unit_interval(df: DataFrame, columns: list[str]) -> DataFrame:
    """df itself if no value of the columns lies outside [0, 1] (nulls and NaN do)."""
    row = df.agg(*[F.count_if(F.col(c).isNull() | ~F.col(c).between(0, 1)).alias(c) for c in columns]).first()
    bad = [c for c in columns if row[c]]
    if bad:
        raise ValueError(f"outside [0, 1]: {', '.join(bad)}")
    return df


def has_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def indexes_within(pairs: DataFrame, n: int, columns: list[str]) -> DataFrame:
    """pairs itself if every index is from 0 to n - 1."""
    row = pairs.agg(*[F.count_if(~F.col(c).between(0, n - 1)).alias(c) for c in columns]).first()
    if any(row):
        raise ValueError(f"indexes outside 0 to {n - 1}")
    return pairs


def enough_bins(pairs: DataFrame, least: int = 8, col: str = "similarity_bin") -> DataFrame:
    n = pairs.agg(F.count_distinct(col)).first()[0]
    if n < least:
        raise ValueError(f"{n} similarity bins have pairs; {least} are asked for")
    return pairs
