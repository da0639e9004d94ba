"""From ``documents`` to token ids: the training-data operators in a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import byte_bpe, exact_dedup, mixing, near_dedup, queries, toxicity
from millrace.llm.common import Stages, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs, keep="smallest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(docs, queries.vocabulary(spark))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

# A fitted model and MinHash candidates are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    stages = Stages(spark, "pipeline")
    before = None
    for name, stage in STAGES:
        step = name.replace(" ", "-")
        docs = stages.write(stage(spark, docs, sf_dir), step)
        if before:  # its rows are in the table just written
            stages.drop(before)
        before = step
    return docs
