"""The corpus pipeline: language ID, exact dedup, near-duplicate join, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame; every stage
but the last returns the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm.common import ensure_checkpoint_dir, table
from pulsegrid.llm.decontamination import decontaminate
from pulsegrid.llm.exact_dedup import drop_copies
from pulsegrid.llm.language_id import keep_known_languages
from pulsegrid.llm.mixing import mix_documents
from pulsegrid.llm.ngram_join import keep_one_each

#: Below this probability of any learned language a document is rejected.
MIN_LANGUAGE_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; those without letters and those it can't tell go."""
    return keep_known_languages(docs, MIN_LANGUAGE_SCORE)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal texts."""
    return drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: spans are cut out, and documents that are mostly benchmark go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their numbers of copies."""
    return mix_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("ngram_join", near_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]

#: SQL can't express the trained network or the rounding; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet to the shared checkpoint folder and read again.

    A stage's folder goes once the next one's result is written; the last one stays, as the rows that come back are read from it.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return docs
