"""The corpus pipeline: each stage is written and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, jaccard_join, language_id, mixing, sharding
from tidemark.llm.common import scratch, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those likelier in no known language than in one, go."""
    return language_id.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.75 Jaccard similarity connect, the one with the smallest id stays."""
    return jaccard_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window, perhaps with other values in its slots, go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate says; copies are rows alike."""
    return mixing.mixture(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row of the mix goes."""
    return sharding.shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The stages' likelihoods and components are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over all documents; a stage's own tables are removed once its result is written.

    Documents with null, empty or letterless texts go in the first stage. Rows alike in id and text share the decisions on
    them, so the second stage keeps them all or none; rows without an id are told apart by their texts. Columns besides
    doc_id, text, lang and source may have any name: the stages pass them on, and the last returns its own columns only.
    An empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark):
        for name, stage in STAGES[:-1]:
            with scratch(spark):
                docs = written(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)  # to the outer scratch
        return written(STAGES[-1][1](spark, docs, sf_dir), f"stage-{STAGES[-1][0]}", keep=True)
