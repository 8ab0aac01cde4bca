"""Summaries of event logs: runs, search traces, embedding traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Event types that an audit keeps.
AUDIT_EVENTS = (
    "ingest.started", "ingest.completed", "index.upserted", "index.deleted", "search.started",
    "search.completed", "fetch.started", "fetch.completed", "fetch.failed",
)


def split_runs(events: DataFrame, stream: str, order: Sequence[str], is_start: Column) -> DataFrame:
    """``run``: how many starts a stream has had so far; events before its first start are run 0."""
    w = Window.partitionBy(stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("run", F.sum(is_start.cast("long")).over(w))


def search_summary(events: DataFrame) -> DataFrame:
    """Per search_id of (search_id, seq, event_type, stage, succeeded, attempted_rerank, applied_rerank, error_type, duration_ms, result_count).

    Fields of a type are those of its last event; flags are kept once set; stages
    and errors are listed in order; an error of the whole search gives way to one of a
    stage.
    """
    last = lambda c, kind: F.max_by(F.when(F.col("event_type") == kind, F.col(c)), F.when(F.col("event_type") == kind, F.col("seq")))
    errors = F.array_sort(F.collect_list(F.when(F.col("event_type") == "stage.error", F.struct("seq", "stage", "error_type"))))
    stages = F.array_sort(F.collect_list(F.when(F.col("event_type") == "search.stage.completed", F.struct("seq", "stage", "duration_ms"))))
    out = events.groupBy("search_id").agg(
        last("result_count", "search.completed").alias("result_count"), last("succeeded", "search.completed").alias("succeeded"), last("duration_ms", "search.completed").alias("duration_ms"),
        F.bool_or(F.coalesce("attempted_rerank", F.lit(False))).alias("attempted_rerank"), F.bool_or(F.coalesce("applied_rerank", F.lit(False))).alias("applied_rerank"),
        F.bool_or(F.col("event_type") == "search.completed").alias("completed"), stages.alias("stages"), errors.alias("errors"), F.count(F.lit(1)).alias("events"),
    )
    inner = F.filter("errors", lambda e: e["stage"] != "search")
    return out.withColumn("errors", F.when(F.size(inner) > 0, inner).otherwise(F.slice("errors", 1, 1)))


def mixed_correlation(events: DataFrame) -> DataFrame:
    """How many events have a search id and how many don't, and whether the log mixes both."""
    n = events.agg(F.count("search_id").alias("correlated"), F.count_if(F.col("search_id").isNull()).alias("uncorrelated"))
    return n.withColumn("mixed", (F.col("correlated") > 0) & (F.col("uncorrelated") > 0))


def embedding_summary(events: DataFrame, group: Sequence[str]) -> DataFrame:
    """Counts, cache counters and the distinct providers in the order of their first event."""
    first = events.groupBy(*group, "provider").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("hits").alias("hits"), F.sum("misses").alias("misses"), F.sum("texts").alias("texts"))
    return first.groupBy(*group).agg(
        F.sum("n").alias("events"), F.sum("texts").alias("texts"), F.sum("hits").alias("hits"), F.sum("misses").alias("misses"),
        F.transform(F.array_sort(F.collect_list(F.struct("first", "provider"))), lambda x: x["provider"]).alias("providers"),
    )


def audit(events: DataFrame, types: Sequence[str] = AUDIT_EVENTS) -> DataFrame:
    return events.filter(F.col("event_type").isin(*types))


def payload(events: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Events as one JSON line each, of allowed fields only; nulls are left out."""
    return events.select(F.to_json(F.struct(*[c for c in allowed if c in events.columns])).alias("line"))
