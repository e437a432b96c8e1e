"""The command line on small files."""

import pytest
from pyspark.sql import functions as F

from dupsift import cli
from dupsift.functions import tokens as T
from dupsift.operators import checks
from dupsift.sources import artifacts, flows


def test_prepare(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    lines = [f" {i % 7}, {i * i % 11}, 5, {'inf' if i % 9 == 0 else i % 5}, {'DDoS' if i % 2 else 'BENIGN'}" for i in range(80)]
    (tmp_path / "raw" / "a.csv").write_text("Flow Duration, Total Fwd Packets, Flag, Idle Mean, Label\n" + "\n".join(lines) + "\n")
    out = str(tmp_path / "out")
    cli.prepare(spark, str(tmp_path / "raw"), out, max_samples=60, max_pairs=200)
    rows = flows.read_prepared(spark, out, "flows")
    assert rows.count() == 60 and "Flag" not in rows.columns
    training = flows.read_prepared(spark, out, "pairs_train")
    assert training.where("is_duplicate = 1 AND label_1 <> label_2 OR is_duplicate = 0 AND label_1 = label_2").count() == 0
    tokens = flows.read_prepared(spark, out, "flows_tokens").first()["tokens"]
    assert tokens[0].startswith("label=") and tokens[1] == "source=a.csv" and len(tokens) == 5
    assert training.count() == 200 and training.where("is_duplicate = 1").count() == 100
    meta = flows.read_metadata(spark, out)
    assert meta["n_flows"] == 60 and meta["dropped_columns"] == ["Flag"] and meta["label_counts"] == {"DDoS": 30, "BENIGN": 30}
    stats = {r["feature"]: r for r in flows.read_prepared(spark, out, "preprocessor").collect()}
    assert not stats["Flag"]["kept"] and stats["Idle Mean"]["kept"] and stats["Flag"]["median"] == 5
    values = cli.train(spark, out, str(tmp_path / "models"), epochs=3, batches=2, hidden=(8,))
    assert len(values["losses"]) == 3 and cli.train(spark, out, str(tmp_path / "models"), epochs=3, batches=2, hidden=(8,)) == values
    assert artifacts.Store(spark, str(tmp_path / "models")).load("encoder")[0]["codes"].count() == 60
    assert {r["label"]: r["n"] for r in flows.labels(spark, out).collect()} == {r["label"]: 30 for r in flows.labels(spark, out).collect()}
    assert {r["label"]: r["n"] for r in flows.labels(spark, str(tmp_path / "none"), str(tmp_path / "raw")).collect()} == {"DDoS": 40, "BENIGN": 40}
    assert {r["Label"]: r["n"] for r in cli.list_labels(spark, f"{out}/flows").collect()} == {"DDoS": 30, "BENIGN": 30}


def test_query_and_evaluate(spark, tmp_path):
    v = [(i, [float((i * j) % 5 - 2) for j in range(64)], i % 2) for i in range(20)]
    spark.createDataFrame(v, "id bigint, embedding array<double>, label int").write.parquet(str(tmp_path / "e"))
    found = cli.query(spark, str(tmp_path / "e"), "4", 3, True, str(tmp_path / "csv"))
    assert 1 <= found.count() <= 3 and spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == found.count()
    assert sorted(map(str, flows.read_result_csv(spark, str(tmp_path / "csv")).collect())) == sorted(map(str, found.select(F.col("query_id").cast("string"), F.col("candidate_id").cast("string"), F.col("query_label").cast("string"), F.col("candidate_label").cast("string"), "hash_bucket_hits", "similarity", "is_same_label", "rank").collect()))
    by_index = cli.query(spark, str(tmp_path / "e"), None, 3, True, None, row_index=4)
    assert sorted(map(str, by_index.collect())) == sorted(map(str, found.collect()))
    for wrong in ({"query_id": "99"}, {"query_id": None, "row_index": 20}, {"query_id": None, "row_index": -1}, {"query_id": "4", "row_index": 4}):
        with pytest.raises(ValueError):
            cli.query(spark, str(tmp_path / "e"), k=3, same_label=True, out=None, **wrong)
    scored = spark.range(100).select((F.col("id") / 100).alias("true_sim"), (F.col("id") / 100).alias("pred_sim"), (F.col("id") > 60).cast("int").alias("is_duplicate"))
    scored.write.parquet(str(tmp_path / "s"))
    assert cli.evaluate(spark, str(tmp_path / "s")).first()["threshold"] == 0.6
    folders = cli.export(spark, str(tmp_path / "s"), str(tmp_path / "exports"))
    assert [spark.read.option("header", True).csv(f).count() for f in folders] == [10, 18, 6]
    (tmp_path / "summary.json").write_text('{"best": {"model": "mlp",\n "f1": 0.5}}')
    assert flows.read_summary(spark, str(tmp_path / "summary.json")).first()["best"]["f1"] == 0.5
    frames = spark.createDataFrame([(["a", "zz", "b", "a"],), ([],)], "f array<string>").select(T.frame_indexes(F.col("f"), ["a", "b"], 3)).collect()
    assert [r[0] for r in frames] == [[1, 0, 2], [0, 0, 0]]
    (tmp_path / "job.log").write_text("one\ntwo\n")
    assert [r["line"] for r in cli.log_tail(spark, str(tmp_path / "job.log"), 1).collect()] == ["two"]
    assert cli.sensitivity(spark, str(tmp_path / "s")).first()["k"] == 1
    for bad in (scored.withColumn("pred_sim", F.lit(1.5)), scored.withColumn("pred_sim", F.lit(None).cast("double"))):
        with pytest.raises(ValueError):
            checks.in_unit_interval(bad, ["pred_sim"])
    with pytest.raises(ValueError):
        checks.indexes_within(spark.range(5), 4, ["id"])
    with pytest.raises(ValueError):
        checks.enough_bins(spark.range(5).withColumnRenamed("id", "similarity_bin"))
