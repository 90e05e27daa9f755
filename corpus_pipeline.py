"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. An empty table passes through every stage. A null text, an empty one and one without a letter are of no language
and go in the first stage; rows with a null id pass as long as their text does; rows that share an id are one document to the
second stage and are judged by their own texts in the others; very long texts are read whole; of equal texts the smallest id
stays; columns of any name pass through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.llm import bpe, common, decontaminate, language_crf, near_dedup, secret_forest


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language was recognised."""
    return language_crf.identify(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    return near_dedup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold benchmark passages in a twentieth of their words or more."""
    return decontaminate.decontaminate(docs, common.read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secret_forest.redact(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, the token ids of each text, and the digest of what they decode to."""
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), bpe.vocabulary_path())
    size = F.size("ids").cast("long").alias("n_tokens")
    return encoded.select("doc_id", "lang", "source", size, "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("bpe_encoding", bpe_encoding),
]

#: No SQL can express the fitted stages; tests/llm checks the pipeline stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
