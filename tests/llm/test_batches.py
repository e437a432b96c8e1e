"""Texts reach Python in small batches, and rounds leave no tables behind."""

import os

import public_tokenizers
import pyarrow as pa

from dupsift.llm import bpe, components, kneser_ney, secret_scan, simhash
from dupsift.llm.common import BATCH_ROWS


def test_counts_take_small_batches(spark, monkeypatch):
    """Counting keys and words too, whose results go to the driver."""
    large, seen = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def watched(texts):
        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                large.add(int(b.num_rows > BATCH_ROWS))
                yield b

        return texts.select("text").mapInArrow(run, "text string")

    keys, words = simhash._key_counts, kneser_ney.count_words
    monkeypatch.setattr(simhash, "_key_counts", lambda texts, similar: keys(watched(texts), similar))
    monkeypatch.setattr(kneser_ney, "count_words", lambda texts: words(watched(texts)))
    docs = spark.range(0, 2500, 1, 1).selectExpr("id AS doc_id", "concat('a b c d e f g h ', id) AS text")
    simhash.similar_links(docs, 0.8)
    assert kneser_ney.train(docs, 1).vocabulary[:8] == list("abcdefgh")
    assert seen.value >= 5000 and large.value == 0


def test_components_keep_one_table(spark, monkeypatch):
    written, plain = [], components.materialize

    def materialize(df, label):
        out = plain(df, label)
        written.append(os.path.dirname(out.inputFiles()[0]).removeprefix("file://"))
        return out

    monkeypatch.setattr(components, "materialize", materialize)
    edges = spark.range(40).selectExpr("id AS a", "id + 1 AS b")
    roots = components.components(edges)
    assert roots.where("root = 0").count() == 41
    assert [os.path.exists(w) for w in written] == [False] * (len(written) - 1) + [True] and len(written) > 2


def test_workers_hold_one_operator(spark):
    """What BPE keeps in a Python worker goes when another operator's task begins there, not before; large batches are taken in parts."""

    class Plain:
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    def batch(n):
        return pa.record_batch([pa.array(range(n), pa.int64()), pa.array(["some words"] * n), pa.array(range(n), pa.int64())], names=["doc_id", "text", "h"])

    bpe.load.cache_clear()
    encode = bpe.encode_documents(Plain(), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for _ in range(2):
        assert [b.num_rows for b in encode(iter([batch(2500)]))] == [1000, 1000, 500]
    assert bpe.load.cache_info()[:2] == (1, 1) and bpe.load.cache_info().currsize == 1
    assert sum(b.num_rows for b in simhash.fingerprints(Plain())(iter([batch(3)]))) == 3
    assert bpe.load.cache_info().currsize == 0
    assert [b.num_rows for b in secret_scan.scan_digests(Plain())(iter([batch(2500)]))] == [1000, 1000, 500]
