"""From raw documents to token files: filter, deduplicate, decontaminate, mix, encode.

A stage's own tables in the shared folder are needed until its result has been
written. The next stage starts from that result, so it deletes them first; one
thread runs one pipeline at a time. What the last stage writes, the token files,
stays.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from corvane.llm.decontam import remove_contaminated
from corvane.llm.mixing import repeat_by_copies
from corvane.llm.quality import quality_filter
from corvane.llm.queries import vocabulary
from corvane.llm.scratch import drop, noted, remove, store
from corvane.llm.simhash import keep_one
from corvane.llm.tables import table
from corvane.llm.token_files import token_digest

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left = threading.local()


def tidy(first: bool = False) -> Callable[[Stage], Stage]:
    """A stage that deletes what the stage before it left; the ``first`` one has none before it."""

    def wrap(f: Stage) -> Stage:
        @wraps(f)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if not first:
                remove(spark, *getattr(_left, "paths", []))
            with noted() as paths:
                out = f(spark, docs, sf_dir)
            _left.paths = paths
            return out

        return run_stage

    return wrap


@tidy(first=True)
def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_filter(docs)


@tidy()
def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs)


@tidy()
def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a whole window of the benchmark, and with less than a twentieth of their words in its shorter items."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


@tidy()
def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return repeat_by_copies(docs)


@tidy()
def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the written token files hold of each document."""
    found = token_digest(docs, vocabulary())
    return found.withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("quality", stage_quality),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("mix", stage_mix),
    ("tokens", stage_tokens),
]

#: Component search, random rounding and byte files have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read back."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop(before)
        before = docs
    return docs
