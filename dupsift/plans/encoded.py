"""Registered queries: the encoder trained on pairs of flows, and the codes that it gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import clean, draws, encoder, lsh
from ..storage import kept
from . import bindings as B
from .catalog import query

_NAMES = ["n_lines", "qty", "max_price", "total"]
_BLOCKS, _WIDTH = 16, 4


def _rows(spark, d):
    """id, label, v: standardised features of the flows."""
    scaled = clean.standardize(clean.impute_median(B.flows(spark, d).select("id", "label", *_NAMES), ["total"]), _NAMES)
    return kept(scaled.select("id", "label", F.array(*_NAMES).alias("v")), "rows")


def _pairs(rows):
    """2,000 drawn pairs with the features of both rows; a few rows, so the table of all isn't moved."""
    slim = rows.select("id", "label")
    placed = draws.ordered(slim, "label")
    pairs = draws.positives(slim, 1000, rows=placed).union(draws.negatives(slim, 1000, rows=placed)).select("id_1", "id_2", "label_1", "label_2")
    one = F.broadcast(kept(pairs, "drawn")).join(rows.select(F.col("id").alias("id_1"), F.col("v").alias("v_1")), "id_1")
    return kept(F.broadcast(one).join(rows.select(F.col("id").alias("id_2"), F.col("v").alias("v_2")), "id_2"), "both")


def _trained(both, kind: str, epochs: int):
    """An encoder fitted to drawn pairs, their target the similarity of the features, and its losses."""
    near = F.when(V.cosine01(F.col("v_1"), F.col("v_2")) >= 0.8, 1.0).otherwise(0.0)
    y = near if kind == "contrastive" else V.cosine01(F.col("v_1"), F.col("v_2"))
    model = encoder.Encoder.new([len(_NAMES), 32, _BLOCKS * _WIDTH])
    losses = encoder.train(both.withColumn("y", y), model, encoder.Objective(_BLOCKS, _WIDTH, kind), epochs, rate=0.01)
    return model, losses


@query()
def encoder_losses(spark, d):
    """The loss of each epoch, for each objective."""
    both = _pairs(_rows(spark, d))
    found = [(kind, epoch, loss) for kind in ("mse", "contrastive", "baseline") for epoch, loss in enumerate(_trained(both, kind, 5)[1])]
    return spark.createDataFrame(found, "kind string, epoch int, loss double")


@query()
def encoder_topk(spark, d):
    """Codes of all flows by the trained encoder, and by them each stated flow's (ids divisible by 50) five nearest. The outputs, which are many times longer than the features, are made where they are compared."""
    rows = _rows(spark, d)
    model = _trained(_pairs(rows), "mse", 5)[0]
    codes = encoder.encode(rows, model, keep=("label", "v"), with_outputs=False)
    coded = kept(codes.select("id", "label", "v", F.get("words", F.lit(0)).alias("word")), "codes")
    return lsh.top_k(coded, coded.where("id % 50 = 0"), 5, 4, 16, vectors=encoder.last_outputs(spark, model), crowded=True)
