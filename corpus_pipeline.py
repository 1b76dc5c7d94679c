"""A corpus pipeline of five operators: quality, near-duplicates, benchmarks, source mix, shards.

Every stage takes the whole table that its predecessor kept. ``run`` writes each stage's rows to the
shared folder and reads them back, so a lost executor costs one stage at most.

A stage's result reads tables that the stage has landed. They are deleted when a later stage of the same thread is given rows that
were written elsewhere, as ``run`` does; as long as stages are handed each other's results, nothing is deleted.

Rows without text or id, repeated rows and tables without rows pass through every stage as its operator says; columns
of any name are kept, and the columns that sharding adds get longer names where they are taken.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tracegraph.llm import decontaminate, mixing, quality_model, sharding, simhash
from tracegraph.llm.common import delete, noting, table
from tracegraph.session import land as keep

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_local = threading.local()


def _left(spark: SparkSession) -> dict[str, list[str]]:
    """What the stages called in this thread have landed, by stage."""
    apps = _local.__dict__.setdefault("apps", {})
    return apps.setdefault(spark.sparkContext.applicationId, {})


def _clear(spark: SparkSession) -> None:
    for paths in _left(spark).values():
        delete(spark, paths)


def staged(stage: Stage) -> Stage:
    @wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _left(spark)
        earlier = [p.rpartition("/")[2] for name, paths in left.items() if name != stage.__name__ for p in paths]
        files = docs.inputFiles() if earlier else []
        if not any(p in f for f in files for p in earlier):
            for name in left:
                if name != stage.__name__:
                    delete(spark, left[name])
        with noting(left.setdefault(stage.__name__, [])):
            return stage(spark, docs, sf_dir)

    return call


@staged
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the compression classifier rejects; texts without words are scored like any other, and without labels nothing is rejected by more than the constant score."""
    return quality_model.keep_good(spark, docs, table(spark, sf_dir, "labels"))


@staged
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each near-duplicate group; rows without id lose to those with one, texts without words are one group."""
    return simhash.drop_near_duplicates(docs)


@staged
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages; rows without text or a benchmark without items lose nothing."""
    return decontaminate.drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


@staged
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each document as often as it is taken, a partial copy cut to its words; n_chars follows the text, and rows without words are not taken."""
    return mixing.mixed(docs)


@staged
def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard of eight of nearly equal bytes and its place there; equal ids are ordered by text, null ids come first."""
    return sharding.shard_by_bytes(docs, shards=8, carry=[c for c in docs.columns if c != "doc_id"])


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("sharding", sharding_stage),
]

# the quality classifier can't be said in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    _clear(spark)
    return docs
