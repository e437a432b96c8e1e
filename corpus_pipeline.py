"""A corpus pipeline: quality classifier, near-duplicate removal, benchmark decontamination, secret redaction, tokenisation.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns of documents, and further columns of
any name stay. Documents with a null or empty text are rejected by the first stage; a null doc_id, lang or source is kept like any other value. Texts of any length are read whole.
Repeated rows (one id and text) are one document for the near-duplicate stage, which keeps one of them, as of ties (texts with equal ids) that with the least hash. An empty table passes through all stages as
an empty one. Without labels only empty texts are rejected; without a benchmark nothing is contaminated.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupsift.llm import bpe, decontaminate, kneser_ney, secret_scan, simhash
from dupsift.llm.common import materialize

#: Least Jaccard similarity of five-word shingles of near copies.
SIMILAR = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go."""
    return kneser_ney.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays: close fingerprints, or five-word shingles of Jaccard similarity 0.8 or more."""
    return simhash.keep_first(docs, similar=SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item, also a re-parameterised one, go."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets; n_chars follows."""
    return secret_scan.redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: n_tokens, digests of the ids and of the decoded bytes, and the ids."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scan", secrets),
    ("byte-level BPE", tokens),
]
#: SQL can't express the stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
    return docs
