"""Corpus pipeline: toxicity, near-duplicates, benchmark passages, personal data, encoding.

Each stage reads what its predecessor kept, as a written table, and returns a DataFrame; all but the
last return the columns of documents. Tables beside the documents come from ``sf_dir``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabguard.llm.bpe import round_trip
from tabguard.llm.common import table
from tabguard.llm.decontamination import drop_contaminated
from tabguard.llm.privacy import sanitise
from tabguard.llm.simhash import near_duplicates
from tabguard.llm.toxicity import drop_toxic, fit_toxicity
from tabguard.session import scratch_path, scratch_scope, write_and_reread


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; null texts are empty and stay."""
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component; of repeated rows of one id any one stays.

    Rows without an id can't be named as anyone's copy and stay.
    """
    found = write_and_reread(near_duplicates(docs).where("doc_id is not null"), "components")
    kept = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    single = docs.join(kept.where("n = 1"), "doc_id", "left_semi")
    repeated = docs.join(kept.where("n > 1"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return single.unionByName(repeated).unionByName(docs.where("doc_id is null")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and the terms that disclose it replaced in their texts."""
    return sanitise(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every document."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", private_data),
    ("byte_bpe", byte_bpe),
]

#: No stage but the last could be said in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        with scratch_scope(spark):  # the stage's own tables go; its result lies outside
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
