"""A corpus pipeline: five stages, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``.
The first four drop documents and keep the columns of ``documents``; the last
adds the SentencePiece ids, their number and the text decoded from them.
"""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, exact_dedup, language_id, sentencepiece_codec, simhash
from tidemark.llm.storage import materialize

#: Whole texts go to Python workers; Arrow holds a batch in memory that the heap's limit does not count.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(spark: SparkSession) -> None:
    """From here on the session sends Arrow batches of that many rows and bytes at most; a smaller setting stays."""
    for key, most in BATCH.items():
        now = int(re.match(r"-?\d+", spark.conf.get(key))[0])
        if not 0 < now <= most or not spark.conf.get(key).lstrip("-").isdigit():
            spark.conf.set(key, str(most))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language can be told; the others have no text or no letter."""
    small_batches(spark)
    return language_id.drop_undetermined(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each set of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group: five words, a similarity of 0.8."""
    small_batches(spark)
    return simhash.drop_near_copies(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no item of the benchmark."""
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text, and decode it again from its ids."""
    small_batches(spark)
    return sentencepiece_codec.encode_and_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("SentencePiece", sentencepiece_stage),
]

#: SQL can express neither the classifier nor the fingerprints; tests/llm compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
