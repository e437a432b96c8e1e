"""Artifacts, log tails, task states, latencies, task requests."""

import os
import time

import pytest
from pyspark.sql import functions as F

from dupsift.operators import latency, tasks
from dupsift.plans import bookkeeping
from dupsift.sources import artifacts, tail
from dupsift.streaming import task_states


def test_artifacts_are_reused_rebuilt_and_checked(spark, tmp_path):
    store, built = artifacts.Store(spark, str(tmp_path / "store")), []
    spark.range(10).write.parquet(str(tmp_path / "in"))

    def build():
        built.append(1)
        df = spark.read.parquet(str(tmp_path / "in"))
        return {"all": df, "even": df.where("id % 2 = 0")}, {"rows": df.count()}

    args = ("pairs", [str(tmp_path / "in")], {"seed": 1}, build)
    tables, values = store.get_or_build(*args)
    assert tables["even"].count() == 5 and values == {"rows": 10}
    again, _ = store.get_or_build(*args)
    assert len(built) == 1 and again["all"].count() == 10 and [a["name"] for a in store.catalogue()] == ["pairs"]
    store.get_or_build("pairs", args[1], {"seed": 2}, build)
    assert len(built) == 2
    spark.range(3).write.mode("append").parquet(str(tmp_path / "in"))
    assert store.get_or_build("pairs", args[1], {"seed": 2}, build)[1] == {"rows": 13} and len(built) == 3
    folder = store.paths("pairs")["all"]
    assert len(os.listdir(tmp_path / "store" / "pairs")) <= 3  # the manifest, its checksum and one key
    lost = next(f for f in os.listdir(folder) if f.startswith("part-"))
    os.remove(f"{folder}/{lost}")
    with pytest.raises(FileNotFoundError, match="lost 1 files"):
        store.get_or_build("pairs", args[1], {"seed": 2}, build)
    assert store.get_or_build("pairs", args[1], {"seed": 2}, build, force=True)[0]["all"].count() == 13 and len(built) == 4
    with pytest.raises(FileNotFoundError):
        store.load("other")
    with pytest.raises(FileNotFoundError):
        store.get_or_build("other", [str(tmp_path / "none")], {}, build)


def test_tail(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("".join(f"line {i}\n" for i in range(50_000)))
    (tmp_path / "logs" / "b.log").write_bytes("é1\r\né2\r\nlast".encode())
    (tmp_path / "logs" / "c.log").write_text("x" * 200_000)
    (tmp_path / "logs" / "d.log").write_text("")
    tail.register(spark)
    rows = spark.read.format("tail").option("lines", 5).load(str(tmp_path / "logs")).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["line_from_end"])):
        by.setdefault(r["path"].rsplit("/", 1)[-1], []).append(r["line"])
        assert r["bytes_read"] <= tail.MOST_BYTES
    assert by["a.log"] == [f"line {i}" for i in range(49_995, 50_000)] and by["b.log"] == ["é1", "é2", "last"] and by["c.log"] == ["x" * (64 << 10)] and "d.log" not in by
    assert max(r["bytes_read"] for r in rows if r["path"].endswith("a.log")) <= tail.RANGE_BYTES
    one = spark.read.format("tail").option("lines", 10_000).load(str(tmp_path / "logs" / "a.log"))
    assert one.count() == tail.MOST_LINES
    with pytest.raises(Exception, match="none.log"):
        spark.read.format("tail").load(str(tmp_path / "none.log")).count()


COMMANDS = [(1, "create"), (2, "run"), (3, "run"), (4, "finish"), (5, "create"), (6, "run"), (7, "fail"), (8, "fail"), (9, "run"), (10, "finish"), (11, "stop")]


def test_stream_of_commands_equals_batch(spark, tmp_path):
    """Task 1 has all commands, over three batches; task 2 begins with a run; illegal moves are rejected."""
    rows = [(1, s, c) for s, c in COMMANDS] + [(2, 1, "run"), (2, 2, "create"), (2, 3, "finish"), (2, 9, "run")]
    table = spark.createDataFrame(rows, "task_id bigint, seq bigint, command string")
    for part in ("seq <= 4", "seq > 4 AND seq <= 8", "seq > 8"):  # files are taken by time
        table.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "c"))
        q = task_states.follow(stream).writeStream.format("memory").queryName("moves").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(key)
    got = {(r["task_id"], r["seq"]): r for r in spark.table("moves").collect()}
    assert [got[1, s]["accepted"] for s, _ in COMMANDS] == [1, 1, 0, 1, 0, 1, 1, 0, 1, 1, 0]
    assert [got[2, s]["accepted"] for s in (1, 2, 3, 9)] == [0, 1, 0, 1]
    final = task_states.states(table)
    batch = {r["task_id"]: (r["state"], r["run"], r["rejected"]) for r in final.collect()}
    last = {t: max(s for k, s in got if k == t) for t in (1, 2)}
    assert batch == {t: (got[t, s]["after"], got[t, s]["run"], sum(1 - r["accepted"] for (k, _), r in got.items() if k == t)) for t, s in last.items()}
    assert batch == {1: ("SUCCESS", 3, 4), 2: ("RUNNING", 1, 2)}
    results = spark.createDataFrame([(1, run, i) for run in (1, 2, 3) for i in range(run)], "task_id bigint, run int, log_id int")
    assert sorted((r["run"], r["log_id"]) for r in task_states.standing(results, final).collect()) == [(3, 0), (3, 1), (3, 2)]


def test_latencies(spark):
    corpus = spark.range(0, 100, 2)
    found = latency.measured(spark, {"few": (corpus, lambda i: spark.range(i)), "one": (corpus, lambda i: spark.range(1))}, most=3)
    assert sorted((r["method"], r["query_id"], r["rows"]) for r in found.collect()) == [("few", 0, 0), ("few", 48, 48), ("few", 98, 98), ("one", 0, 1), ("one", 48, 1), ("one", 98, 1)]
    assert all(r["avg_query_latency_ms"] > 0 and r["queries"] == 3 for r in latency.average(found).collect())


def test_task_requests(spark):
    good = {"task_name": "t", "model_type": " MLP ", "similarity_threshold": 0.6, "time_window": 60, "reserve_policy": "EARLIEST", "hash_bits": 32}
    row = tasks.new_task(spark, good).first()
    assert (row["model_type"], row["status"], float(row["similarity_threshold"]), row["top_k"], row["total_logs"]) == ("mlp", "PENDING", 0.6, 10, 0)
    for bad in ({"task_name": " "}, {"similarity_threshold": 0.05}, {"similarity_threshold": 1.5}, {"time_window": None}, {"label_scope": "none"}, {"top_k": 0}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            tasks.validated({k: v for k, v in (good | bad).items() if v is not None})


def test_displayed_models(spark):
    df = spark.createDataFrame([("b",), ("x",), ("a",)], "model string")
    got = {r["model"]: (r["display_name"], r["place"]) for r in tasks.displayed(df, {"a": "A!", "b": "B!"}).collect()}
    assert got == {"a": ("A!", 1), "b": ("B!", 2), "x": ("x", 3)}
    assert tasks.displayed(df, {"a": "A!"}, core=["a"]).select(F.count("*")).first()[0] == 1


def test_query_latency_signs_texts_once(spark, monkeypatch):
    """Not again for each query, however often its plan reads them."""
    signed = spark.sparkContext.accumulator(0)

    def words(spark, d):
        def run(batches):
            for b in batches:
                signed.add(b.num_rows)
                yield b

        return spark.range(300).selectExpr("id", "xxhash64(id) AS word").mapInArrow(run, "id bigint, word bigint")

    monkeypatch.setattr(bookkeeping, "_doc_simhash", words)
    assert bookkeeping.query_latency(spark, "/root/testdata/sf0.001").count() == 10
    assert signed.value == 300


def test_latency_includes_the_plan(spark):
    """A plan may write tables before its last step."""

    def slow(i):
        time.sleep(0.3)
        return spark.range(1)

    assert all(r["ms"] >= 300 for r in latency.measured(spark, {"slow": (spark.range(3), slow)}, most=2).collect())
