"""The corpus pipeline: stages over documents, each one's rows written as Parquet and read again by the next.

toxicity and quality drop the documents they reject, near_dedup keeps one row of each group of near duplicates, of its smallest id,
decontaminate drops documents that hold a passage of the benchmark, and bpe encodes what is left. All stages but the
last return the columns of documents. Rows without an id are never dropped as near duplicates of another;
rows of one id with different texts stand for themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontam, quality, simhash, toxicity
from millrace.llm.common import read, scratch


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score is 0.5 or more."""
    kept = toxicity.scored(docs, read(spark, sf_dir, "labels")).filter("predicted = 0")
    return kept.select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the base or divergence rules reject."""
    return quality.judged(docs).filter("kept").select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: one of the smallest id in it; and all rows without an id."""
    return simhash.one_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage of the benchmark."""
    found = decontam.with_matches(docs, read(spark, sf_dir, "benchmark"))
    return found.filter(F.size("matches") == 0).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each document."""
    done = bpe.with_round_trip(docs.select("doc_id", "text"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("bpe", bpe_stage),
]

#: Learned scores, edit search and tokenisation are beyond SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written in the shared folder before the next reads it."""
    folder = scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
