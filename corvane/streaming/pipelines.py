"""Structured Streaming: ingest by upsert, windowed monitoring, deduplication, trace folding."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.operators.lifecycle import recover_buckets, swap_buckets, upsert


def read_json(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def ingest(stream: DataFrame, target: str, checkpoint: str, key: str = "id", order: str = "line_no", once: bool = True, buckets: int = 64) -> StreamingQuery:
    """Upsert each micro-batch into the Parquet table at ``target``, which lies in ``buckets`` by hash of the key.

    A batch rewrites the buckets that its keys fall into and no others. One that runs
    again after a crash gives the same table; a crash between the renames of a bucket is
    repaired before the next batch.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        dealt = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in dealt.select("bucket").distinct().collect()]  # ``buckets`` numbers at most
        if not touched:
            return
        if recover_buckets(spark, target):
            old = spark.read.schema(dealt.drop(order).schema).parquet(target).filter(F.col("bucket").isin(touched))
        else:
            old = spark.createDataFrame([], dealt.drop(order).schema)
        swap_buckets(upsert(old, dealt, key, order), target)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def watermarked(events: DataFrame, late: str) -> DataFrame:
    """A stream with a watermark on ``ts``; a time without zone is taken as the session's. Finished tables need none."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed_counts(events: DataFrame, size: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events and their summed value by tumbling or sliding window and type; rows later than ``late`` are dropped by a stream."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    held = watermarked(events, late)
    return held.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: runs of events less than ``gap`` apart."""
    held = watermarked(events, late)
    return held.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def distinct_events(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark; of a finished table, of each key."""
    return watermarked(events, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def fold_traces(events: DataFrame, idle_ms: int = 600_000) -> DataFrame:
    """Per search_id a running summary: events, last stage, failed and completed; the state goes when idle or complete."""
    schema = "search_id string, events long, last_stage string, failed boolean, completed boolean"

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, stage, failed, completed = state.get if state.exists else (0, None, False, False)
        for f in frames:
            f = f.sort_values("seq")
            n += len(f)
            named = f["stage"].dropna()
            stage = named.iloc[-1] if len(named) else stage
            failed = bool(failed or (f["event_type"] == "stage.error").any())
            completed = bool(completed or (f["event_type"] == "search.completed").any())
        if completed:
            if state.exists:
                state.remove()
        else:
            state.update((n, stage, failed, completed))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], n, stage, failed, completed)], columns=["search_id", "events", "last_stage", "failed", "completed"])

    return events.groupBy("search_id").applyInPandasWithState(fold, schema, "n long, stage string, failed boolean, completed boolean", "update", GroupStateTimeout.ProcessingTimeTimeout)
