"""A session with the settings that the operators assume."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build(app: str = "dupsift", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; shuffle partitions twice the local cores unless given. On a cluster leave master out."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        if "spark.sql.shuffle.partitions" not in conf:
            b = b.config("spark.sql.shuffle.partitions", str(2 * (os.cpu_count() or 4)))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
