"""python -m dupsift.cli COMMAND: prepare, train, query, list-labels, evaluate, sensitivity, diagnostics, export, tail. Tables in, Parquet or CSV out."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors as V
from .operators import checks, clean, draws, encoder, lsh, metrics, reports
from .session import build
from .sources import artifacts, flows, tail
from .storage import kept as store


def prepare(spark: SparkSession, raw: str, out: str, max_samples: int = 0, max_pairs: int = 20_000, negatives: str = "random", seed: int = 42) -> None:
    """Raw captures to flows, tokens, vocabulary and training pairs. max_samples <= 0 takes all rows; medians, edges and scales are those of the sample."""
    df = flows.read_flows(spark, raw)
    meta = ["sample_id", "Label", "source_file", "source_row_index"]
    features = [c for c in df.columns if c not in meta]
    df = df.select("sample_id", clean.normalize_label(F.col("Label")).alias("Label"), "source_file", "source_row_index", *[clean.to_number(F.col(f"`{c}`")).alias(c) for c in features])
    df = clean.balanced_sample(df, max_samples, "Label", "sample_id", seed)
    # A missing value is the median in the matrix, 0 in the tokens.
    filled = clean.drop_constant(clean.impute_median(df, features), features)
    kept = [c for c in features if c in filled.columns]
    chosen = clean.sequence_features(kept)
    zero = df.na.fill(0.0, chosen)
    tokens = zero.select("sample_id", F.col("Label").alias("label"), clean.bin_tokens(F.col("Label"), F.col("source_file"), clean.bin_edges(zero, chosen)).alias("tokens"))
    scaled = clean.standardize(filled, kept)
    rows = scaled.select(F.col("sample_id").alias("id"), F.col("Label").alias("label"), F.array(*[F.col(f"`{c}`") for c in kept]).alias("v")).join(tokens.select(F.col("sample_id").alias("id"), "tokens"), "id")
    rows = store(rows, "rows")
    training = draws.training_pairs(rows, max_pairs, negatives, seed)
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row for each label
    tables = {"flows": scaled, "flows_tokens": tokens, "pairs_train": training, "vocab": clean.vocabulary(tokens), "preprocessor": clean.preprocessor(df, features)}
    meta_data = {"n_flows": sum(counts.values()), "feature_columns": kept, "dropped_columns": [c for c in features if c not in kept], "sequence_features": chosen, "label_counts": counts, "max_samples": max_samples, "max_pairs": max_pairs, "negative_strategy": negatives, "seed": seed}
    flows.write_prepared(tables, out, meta_data)


def train(spark: SparkSession, prepared: str, out: str, kind: str = "mse", epochs: int = 10, batches: int = 8, blocks: int = 16, width: int = 4, hidden: tuple[int, ...] = (256, 128), seed: int = 42) -> dict:
    """An encoder fitted to prepared pairs, and the codes of all prepared flows, as the artifact `encoder` in out; it is reused while the prepared tables are the same."""
    inputs, params = [f"{prepared}/flows", f"{prepared}/pairs_train"], {"kind": kind, "epochs": epochs, "batches": batches, "blocks": blocks, "width": width, "hidden": list(hidden), "seed": seed}

    def build() -> tuple[dict[str, DataFrame], dict]:
        columns = flows.read_metadata(spark, prepared)["feature_columns"]
        rows = flows.read_prepared(spark, prepared, "flows").select(F.col("sample_id").alias("id"), F.col("Label").alias("label"), F.array(*[F.col(f"`{c}`") for c in columns]).alias("v"))
        pairs = flows.read_prepared(spark, prepared, "pairs_train")
        side = lambda n: rows.select(F.col("id").alias(f"id_{n}"), F.col("v").alias(f"v_{n}"))
        y = F.col("target_similarity" if kind == "mse" else "is_duplicate")
        model = encoder.Encoder.new([len(columns), *hidden, blocks * width], seed)
        losses = encoder.train(pairs.join(side(1), "id_1").join(side(2), "id_2").withColumn("y", y), model, encoder.Objective(blocks, width, kind), epochs, batches, seed=seed)
        weights = spark.createDataFrame([(i, w.ravel().tolist(), list(w.shape), b.tolist()) for i, (w, b) in enumerate(model.layers)], "layer int, weights array<double>, shape array<int>, biases array<double>")
        return {"codes": encoder.encode(rows, model), "weights": weights}, {"losses": losses, "columns": columns}

    return artifacts.Store(spark, out).get_or_build("encoder", inputs, params, build)[1]


def export(spark: SparkSession, scored: str, out: str) -> list[str]:
    """Calibration curve, threshold sweep and sensitivity of scored pairs as CSV."""
    df = _scored(spark, scored)
    own = df.select(F.col("pred_sim").alias("score"), F.col("is_duplicate").alias("truth"))
    return flows.export_csv({"calibration": metrics.calibration_curve(df), "thresholds": metrics.sweep(own, metrics.DEFAULT_THRESHOLDS), "sensitivity": sensitivity(spark, scored)}, out)


def log_tail(spark: SparkSession, path: str, lines: int) -> DataFrame:
    tail.register(spark)
    return spark.read.format("tail").option("lines", lines).load(path).orderBy("path", "line_from_end")


def query(spark: SparkSession, embeddings: str, query_id: str | None, k: int, same_label: bool, out: str | None, id_col: str = "id", vector: str = "embedding", label: str = "label", row_index: int | None = None) -> DataFrame:
    """The k nearest by bucket hits and cosine of one row, by its id or its place in the order of ids; ValueError if there is no such row."""
    coded = lsh.codes(spark.read.parquet(embeddings), id_col, vector, label)
    q = flows.row_at(coded, "id", query_id, row_index)
    found = lsh.top_k(coded, q, k, *lsh.shape_for(coded.count()), same_label)
    if out:
        flows.write_result_csv(found, out)
    return found


def list_labels(spark: SparkSession, table: str, label: str = "Label") -> DataFrame:
    return spark.read.parquet(table).groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label)


def _scored(spark: SparkSession, path: str) -> DataFrame:
    df = checks.has_columns(spark.read.parquet(path), ["true_sim", "pred_sim", "is_duplicate"])
    return checks.in_unit_interval(df, ["true_sim", "pred_sim"])


def evaluate(spark: SparkSession, scored: str) -> DataFrame:
    """Best threshold of scored pairs (true_sim, pred_sim, is_duplicate) with its measures."""
    return metrics.best_threshold(_scored(spark, scored).select(F.col("pred_sim").alias("score"), F.col("is_duplicate").alias("truth")), metrics.DEFAULT_THRESHOLDS)


def sensitivity(spark: SparkSession, scored: str) -> DataFrame:
    """Calibration of the S-curves of a grid of (K, L)."""
    df, out = _scored(spark, scored), None
    for k, n in [(1, 1), (1, 5), (1, 10), (1, 20), (2, 20), (4, 20)]:
        one = metrics.calibration(df.withColumn("pred_sim", V.lsh_probability(F.col("true_sim"), k, n))).select(F.lit(k).alias("k"), F.lit(n).alias("l"), "*")
        out = one if out is None else out.union(one)
    return out.orderBy("recommendation", "mae")


def diagnostics(spark: SparkSession, codes: str, scored: str, bits: int) -> DataFrame:
    return reports.diagnostics(spark.read.parquet(codes), _scored(spark, scored), bits)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="dupsift", description=__doc__)
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("prepare")
    a.add_argument("raw"), a.add_argument("out")
    a.add_argument("--max-samples", type=int, default=12_000), a.add_argument("--max-pairs", type=int, default=20_000), a.add_argument("--negatives", choices=["random", "hard"], default="random")
    a = sub.add_parser("query")
    a.add_argument("embeddings"), a.add_argument("query_id", nargs="?"), a.add_argument("--row-index", type=int), a.add_argument("--k", type=int, default=10), a.add_argument("--all-labels", action="store_true"), a.add_argument("--out"), a.add_argument("--id", default="id")
    a = sub.add_parser("list-labels")
    a.add_argument("table"), a.add_argument("--label", default="Label")
    for name in ("evaluate", "sensitivity"):
        sub.add_parser(name).add_argument("scored")
    a = sub.add_parser("diagnostics")
    a.add_argument("codes"), a.add_argument("scored"), a.add_argument("--bits", type=int, default=64)
    a = sub.add_parser("train")
    a.add_argument("prepared"), a.add_argument("out"), a.add_argument("--kind", choices=["mse", "contrastive"], default="mse"), a.add_argument("--epochs", type=int, default=10)
    a = sub.add_parser("export")
    a.add_argument("scored"), a.add_argument("out")
    a = sub.add_parser("tail")
    a.add_argument("path"), a.add_argument("--lines", type=int, default=200)
    o = p.parse_args(args)
    spark = build("dupsift", o.master)
    if o.command == "prepare":
        prepare(spark, o.raw, o.out, o.max_samples, o.max_pairs, o.negatives)
        return
    if o.command in ("train", "export"):
        print(train(spark, o.prepared, o.out, o.kind, o.epochs) if o.command == "train" else export(spark, o.scored, o.out))
        return
    run = {
        "query": lambda: query(spark, o.embeddings, o.query_id, o.k, not o.all_labels, o.out, o.id, row_index=o.row_index),
        "tail": lambda: log_tail(spark, o.path, o.lines),
        "list-labels": lambda: list_labels(spark, o.table, o.label),
        "evaluate": lambda: evaluate(spark, o.scored),
        "sensitivity": lambda: sensitivity(spark, o.scored),
        "diagnostics": lambda: diagnostics(spark, o.codes, o.scored, o.bits),
    }
    run[o.command]().show(100, truncate=False)


if __name__ == "__main__":
    main()
