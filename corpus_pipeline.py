"""The corpus pipeline: quality, exact dedup, near dedup, repeated passages, packing.

Each stage takes all documents that its predecessor kept, with their columns, and is written as Parquet
before the next reads it, so a lost executor costs at most the stage that runs. All but the last return
the columns of ``documents``; the last returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm import exact_dedup, minhash, packing, quality, queries, suffix_dedup
from tarmac.plans.work import Workspace, scratch


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, trained on labelled rows outside the held-out fold."""
    return quality.score(docs, quality.train(docs, queries.table(spark, sf_dir, "labels")), keep=True)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts are equal but for white space."""
    return exact_dedup.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    return minhash.keep(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that repeat; ``n_chars`` follows the text."""
    shorter = suffix_dedup.RepeatedPassages(docs).keep()
    length = F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return shorter.withColumn("n_chars", length)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens."""
    return packing.pack(docs, queries.WORD_BPE)


STAGES = [
    ("quality", keep_good),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("repeated passages", drop_passages),
    ("packing", pack_sequences),
]

#: Model scores, passages and packing are not expressible in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    space = Workspace(spark, "pipeline")
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch():
            docs = space.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
