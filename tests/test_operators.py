"""Operators on hand-made tables, sources, sinks and streams."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dupsift.functions import tokens as T
from dupsift.functions import vectors as V
from dupsift.operators import clean, lsh, metrics, pairs, tasks, text_similarity
from dupsift.sources import flows
from dupsift.streaming import dedup


def test_cleaning(spark):
    df = spark.createDataFrame([(1, " Web Attack – XSS ", "1.5"), (2, "DDoS", "inf"), (3, "Web Attack � XSS", "junk"), (4, "DDoS", "NaN"), (5, "x", None), (6, "y", "4")], "id int, label string, raw string")
    out = df.select("id", clean.normalize_label(F.col("label")).alias("label"), clean.to_number(F.col("raw")).alias("x"), F.lit(7.0).alias("c"))
    rows = out.orderBy("id").collect()
    assert [r["label"] for r in rows[:3]] == ["Web Attack - XSS", "DDoS", "Web Attack - XSS"] and [r["x"] for r in rows] == [1.5, None, None, None, None, 4.0]
    filled = clean.impute_median(out, ["x"])
    assert [r["x"] for r in filled.orderBy("id").collect()] == [1.5, 2.75, 2.75, 2.75, 2.75, 4.0]
    assert clean.drop_constant(filled, ["x", "c"]).columns == ["id", "label", "x"]
    scaled = [r["x"] for r in clean.standardize(filled, ["x", "c"]).orderBy("id").collect()]
    x = np.array([1.5, 2.75, 2.75, 2.75, 2.75, 4.0])
    assert scaled == pytest.approx((x - x.mean()) / x.std())


def test_edges(spark):
    rng = np.random.default_rng(0)
    x = np.r_[rng.integers(0, 5, 200), rng.normal(size=50)]
    df = spark.createDataFrame([(float(v), 3.0, None) for v in x], "x double, c double, n double")
    edges = clean.bin_edges(df, ["x", "c", "n"])
    assert edges["x"] == pytest.approx(np.unique(np.quantile(x, np.linspace(0, 1, 9)))) and edges["c"] == [3.0, 4.0] and edges["n"] == [0.0, 1.0]


def test_sequence_features():
    assert clean.sequence_features(["b", "Flow Duration", "a"]) == ["Flow Duration", "b", "a"]
    many = [f"f{i}" for i in range(30)]
    assert clean.sequence_features(many) == many[:16]
    assert clean.sequence_features(clean.PREFERRED_FEATURES + ["x"]) == clean.PREFERRED_FEATURES


def test_vocabulary_and_encoding(spark):
    df = spark.createDataFrame([(1, ["b", "a"]), (2, ["a", "c", "b", "a"]), (3, ["zz"])], "id int, tokens array<string>")
    vocab = clean.vocabulary(df.where("id < 3"))
    assert {r["token"]: r["token_id"] for r in vocab.collect()} == {"a": 2, "b": 3, "c": 4}
    assert {r["id"]: r["ids"] for r in clean.encode(df, vocab, 3).collect()} == {1: [3, 2, 0], 2: [2, 4, 3], 3: [1, 0, 0]}


def test_balanced_sample(spark):
    df = spark.createDataFrame([(i, "a" if i < 50 else "b" if i < 53 else "c") for i in range(100)], "id int, label string")
    n = {r["label"]: r["count"] for r in clean.balanced_sample(df, 30).groupBy("label").count().collect()}
    assert n["b"] == 3 and sum(n.values()) == 30 and min(n["a"], n["c"]) >= 10
    assert clean.balanced_sample(df, 0).count() == clean.balanced_sample(df, 500).count() == 100


def coded(spark, words, labels=None):
    """Codes of 64 signs from integers."""
    bits = [[1.0 if w >> (63 - i) & 1 else -1.0 for i in range(64)] for w in words]
    return lsh.codes(spark.createDataFrame([(i, b, (labels or [0] * len(words))[i]) for i, b in enumerate(bits)], "id bigint, v array<double>, label int"), "id", "v", "label")


def test_top_k(spark):
    c = coded(spark, [0, 1, 0xFE00, (1 << 64) - 1, 0], [0, 0, 0, 0, 1])
    near = {(r["query_id"], r["rank"]): (r["candidate_id"], r["hash_bucket_hits"]) for r in lsh.top_k(c, c, 2, 8, 8).collect()}
    assert near[0, 1] == (1, 7) and near[0, 2] == (2, 7) and near[3, 1][1] == 0 and (4, 1) not in near
    everyone = {(r["query_id"], r["rank"]): r["candidate_id"] for r in lsh.top_k(c, c, 2, 8, 8, same_label=False).collect()}
    assert everyone[4, 1] == 0 and everyone[0, 1] == 4
    assert {r["id"] for r in lsh.without_candidates(c, c, 8, 8).collect()} == {3, 4}


def test_buckets_hold_duplicates(spark):
    c = coded(spark, [5, 5, 9, 5 << 40])
    pairs_ = {(r["a"], r["b"]): r["hits"] for r in lsh.candidates(c, 4, 16).collect()}
    assert (0, 1) not in pairs_ and pairs_[0, 2] == 3 and {r["n"] for r in lsh.classes(c).collect()} == {2, 1}
    assert lsh.buckets(c, 4, 16).where("id IN (0, 1)").count() == 8


def test_large_buckets_are_cut(spark):
    """Forty codes share the first 16 bits; ten of them the next 16 too."""
    c = coded(spark, [(7 << 48) | ((3 if i < 10 else i) << 32) | i for i in range(40)])
    whole = {(r["a"], r["b"]) for r in lsh.candidates(c, 4, 16).collect()}
    cut = {(r["a"], r["b"]): r["hits"] for r in lsh.candidates(c, 4, 16, split_above=20).collect()}
    assert len(whole) == 780 and len(cut) < 780 and all(cut[a, b] == 2 for a in range(10) for b in range(a + 1, 10))
    assert {(r["a"], r["b"]) for r in lsh.candidates(c, 4, 16, split_above=50).collect()} == whole
    assert lsh.shape_for(1_000) == (8, 8) and lsh.shape_for(1 << 20) == (4, 16) and lsh.shape_for(1 << 40) == (2, 32)


def test_pair_samples(spark):
    df = spark.createDataFrame([(i, i % 3, [f"t{i % 5}", f"u{i % 7}", "label=x"]) for i in range(90)], "id bigint, label int, tokens array<string>")
    p, n = pairs.positive(df), pairs.negative(df)
    assert p.where("label_1 <> label_2 OR id_1 = id_2").count() == 0 and p.count() > 50
    assert n.where("label_1 = label_2").count() == 0 and n.count() > 20
    hard = pairs.hard_negative(df)
    assert hard.count() and hard.where("token_jaccard < 0.3 OR token_jaccard > 0.5 OR label_1 = label_2").count() == 0
    assert pairs.negative(df.withColumn("label", F.lit(1))).count() == 0
    scored = spark.range(1000).select(F.col("id").alias("id_1"), (F.col("id") + 1).alias("id_2"), (F.col("id") / 1000).alias("true_sim"))
    assert [r["count"] for r in pairs.stratified(scored, 100).groupBy("similarity_bin").count().collect()] == [10] * 10
    parts = {r["part"]: r["count"] for r in pairs.split(scored, "id_1").groupBy("part").count().collect()}
    assert abs(parts["plot"] - 200) < 50 and abs(parts["validation"] - 160) < 50


def test_jaccard_join(spark):
    rng = np.random.default_rng(2)
    sets = [sorted({f"w{x}" for x in rng.integers(0, 12, rng.integers(1, 9))}) for _ in range(120)] + [[]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id bigint, tokens array<string>")
    first = {}
    for i, s in enumerate(sets):
        if s:
            first.setdefault(tuple(s), i)
    reps = sorted(first.values())
    want = {(a, b) for a in reps for b in reps if a < b and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.6}
    assert {(r["a"], r["b"]) for r in text_similarity.jaccard_join(df, 0.6).collect()} == want


def test_metrics(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.4, 1), (0.1, 0)], "score double, truth int")
    r = metrics.confusion(df, 0.5).first()
    assert (r["tp"], r["tn"], r["fp"], r["fn"], r["precision"]) == (1, 1, 1, 1, 0.5)
    none = metrics.confusion(df, 2.0).first()
    assert (none["precision"], none["recall"], none["f1"]) == (0, 0, 0)
    best = metrics.best_threshold(df, [0.1, 0.3, 0.5, 0.85]).first()
    assert best["threshold"] == 0.3 and best["recall"] == 1
    models = spark.createDataFrame([("a", None, 0.5, 0.5), ("b", 0.2, 0.1, 0.1)], "model string, f1 double, recall double, precision double")
    assert metrics.best_model(models).first()["model"] == "b"


def test_correlations(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 20, 300), rng.integers(0, 9, 300)
    y = y + x // 4
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    frame = pd.DataFrame({"x": x, "y": y})
    ranks = frame.rank()
    assert metrics.pearson(df, "x", "y").first()[0] == pytest.approx(frame.corr().iloc[0, 1], abs=1e-6)
    assert metrics.spearman(df, "x", "y").first()[0] == pytest.approx(ranks.corr().iloc[0, 1], abs=1e-6)
    s = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
    tau = s.sum() / np.sqrt((np.sign(x[:, None] - x) ** 2).sum() * (np.sign(y[:, None] - y) ** 2).sum())
    assert metrics.kendall(df, "x", "y").first()[0] == pytest.approx(tau, abs=1e-6)
    assert metrics.pearson(df.withColumn("y", F.lit(1.0)), "x", "y").first()[0] == 0


def test_calibration_bands(spark):
    df = spark.createDataFrame([(0.5, 0.6), (0.85, 0.8)], "true_sim double, pred_sim double")
    r = metrics.calibration(df).first()
    assert (r["mid_count"], r["high_count"]) == (1, 1) and r["mid_gap"] == pytest.approx(0.1)
    empty = metrics.calibration(df.limit(0)).first()
    assert (empty["mae"], empty["mid_gap"], empty["high_gap"]) == (0, 1, 1)


def test_tasks(spark):
    df = spark.createDataFrame([("t", 1, 0.95, 1), ("t", 2, 0.94999, 2), ("u", 1, 0.2, 1)], "task string, id int, similarity double, rank int")
    out = tasks.task_results(df, 0.95)
    assert [r["is_redundant"] for r in out.orderBy("task", "log_id").collect()] == [1, 0, 0]
    stats = {r["task"]: r["compression_rate"] for r in tasks.task_stats(out, "task").collect()}
    assert stats == {"t": 50.0, "u": 0.0}
    assert [r[0] for r in spark.createDataFrame([("  ",), (None,), (" MLP ",)], "m string").select(tasks.model_type(F.col("m"))).collect()] == ["bigru", "bigru", "mlp"]


def test_csv_sources(spark, tmp_path):
    (tmp_path / "b.csv").write_text(" Label , Flow Duration\nDDoS,1\nBENIGN,2\n")
    (tmp_path / "a.csv").write_text("Label,Other\nX,5\n")
    rows = flows.read_flows(spark, str(tmp_path)).select("sample_id", "Label", "Flow Duration", "Other").collect()
    assert sorted(tuple(r) for r in rows) == [("a.csv#0", "X", None, "5"), ("b.csv#0", "DDoS", "1", None), ("b.csv#1", "BENIGN", "2", None)]
    with pytest.raises(FileNotFoundError):
        flows.list_csv(spark, str(tmp_path / "none"))
    (tmp_path / "up.csv").write_text("Src IP,protocol,Label\n1.1.1.1,6,DDoS\n")
    r = flows.read_upload(spark, str(tmp_path / "up.csv")).first()
    assert (r["src_ip"], r["dst_ip"], r["attack_type"], r["raw_text"]) == ("1.1.1.1", None, "DDoS", "1.1.1.1 | 6 | DDoS")
    (tmp_path / "m.csv").write_text("model,f1\na,null\nb,0.5\n")
    assert [r["f1"] for r in flows.read_metrics(spark, str(tmp_path / "m.csv")).orderBy("model").collect()] == [None, "0.5"]
    flows.write_prepared({"vocab": spark.range(3)}, str(tmp_path / "p"))
    assert flows.read_prepared(spark, str(tmp_path / "p"), "vocab").count() == 3
    with pytest.raises(FileNotFoundError):
        flows.read_prepared(spark, str(tmp_path / "p"), "flows")


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", "event_type", "ts")
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    q = dedup.dedup_stream(stream, ["user_id", "event_type"], window="400 days").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == events.select("user_id", "event_type").distinct().count()


def test_queries_match_sql(spark):
    """Every registered query without the optional subpackage against DuckDB is the driver's check; here one of each kind."""
    import duckdb

    from dupsift.plans import bookkeeping, catalog, drawn, retrieval  # noqa: F401

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in "orders lineitem events embeddings documents".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name in ("label_histogram", "standard_scale", "lsh_topk", "best_threshold", "jaccard_pairs", "recall_at_k", "redundancy_task_stats", "pairs_drawn_positive", "simhash_topk", "retrieval_by_method", "task_final_states"):
        got = catalog.QUERIES[name](spark, d).toPandas()
        want = c.sql(catalog.SQL[name]).df()[list(got.columns)]
        order = list(got.columns)
        pd.testing.assert_frame_equal(got.sort_values(order).reset_index(drop=True), want.sort_values(order).reset_index(drop=True), check_dtype=False)
