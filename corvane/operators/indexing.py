"""Indexing as table operations: document identities, batched embedding, index updates, forgetting, recovery.

Every step that changes several tables is written down first (``journal`` rows), so
that a run that dies half way is finished by the next one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.identity import document_id

T = TypeVar("T")
FORGET_STAGES = ("store", "sidecar", "embedding_cache", "context_cache", "manifest")
KEY = ["namespace", "collection", "document_id"]


def document_key_of(key: Column, path: Column, filename: Column) -> Column:
    """The key that was given, else the path, else the file's name; blank ones are none."""
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(given(key), given(path), F.trim(filename))


def document_id_of(given: Column, namespace: Column, collection: Column, key: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), document_id(namespace, collection, key))


def collection_name(base: str, model: Column, dimensions: Column, slug: Column | None = None, dimension_aware: bool = True) -> Column:
    """Name of the table for a model: base, a tenant's slug if there is one, the model in lower case with underscores, its dimensions."""
    tenant = F.when(F.coalesce(slug, F.lit("")) != "", F.concat(F.lit("__"), slug)).otherwise("") if slug is not None else F.lit("")
    if not dimension_aware:
        return F.concat(F.lit(base), tenant)
    name = F.regexp_replace(F.regexp_replace(F.lower(F.trim(model)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit(base), tenant, F.lit("__"), name, F.lit("_"), dimensions.cast("string"), F.lit("d"))


def path_segment(value: Column) -> Column:
    """Whether a name may be one lower-case segment of a manifest's path."""
    return F.coalesce((value != "") & (value == F.trim(value)) & ~value.isin(".", "..") & ~F.contains(value, F.lit("/")) & ~F.contains(value, F.lit("\\")) & (value == F.lower(value)), F.lit(False))


def check_segment(label: str, value: str) -> str:
    if not value or value != value.strip() or value in (".", "..") or re.search(r"[/\\]", value) or value != value.lower():
        raise ValueError(f"{label} must be one lower-case path segment")
    return value


def resolve_dimensions(known: dict[tuple[str, str], dict], provider: str, model: str, dimensions: int | None) -> int:
    """Dimensions to use: those asked for if the model (``default``, ``allowed``, ``most``, ``fixed``) has them, else its default."""
    spec = known.get(((provider or "").strip().lower(), model))
    if dimensions is None:
        if spec is None:
            raise ValueError(f"dimensions are needed for {provider}/{model}")
        return spec["default"]
    if isinstance(dimensions, bool) or not isinstance(dimensions, int) or dimensions <= 0:
        raise ValueError("dimensions must be a positive whole number")
    if spec and (spec.get("fixed") and dimensions != spec["default"] or spec.get("allowed") and dimensions not in spec["allowed"] or dimensions > spec.get("most", dimensions)):
        raise ValueError(f"{provider}/{model} has no {dimensions} dimensions")
    return dimensions


def index_document(points: DataFrame, incoming: DataFrame) -> DataFrame:
    """Points after documents were indexed anew: a document in ``incoming`` has its incoming chunks and no others; one whose only row has a null chunk_index is empty and goes."""
    known = incoming.select(*KEY).distinct()
    return points.join(known, KEY, "left_anti").unionByName(incoming.filter("chunk_index is not null"), allowMissingColumns=True)


def cached_vectors(texts: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame], dimension: int) -> DataFrame:
    """(key, vec) of each text (key, text): the cache's vector if it has one of ``dimension``, else the one that ``embed`` gives for the rest."""
    sound = cache.filter(F.size("vec") == dimension).select("key", "vec")
    made = embed(texts.join(sound, "key", "left_anti"))
    wrong = F.raise_error(F.lit(f"a vector is not of dimension {dimension}")).cast(made.schema["vec"].dataType)
    return texts.select("key").join(sound, "key").unionByName(made.select("key", F.when(F.size("vec") == dimension, F.col("vec")).otherwise(wrong).alias("vec")))


def sparse_channels(rows: DataFrame, channels: Sequence[str], embed: dict[str, Callable[[DataFrame], DataFrame]], fallback: str = "bm25") -> DataFrame:
    """(key, channel, idx, val) for each channel; one that no embedder is known for takes the fallback's."""
    out = None
    for c in channels:
        part = embed.get(c, embed[fallback])(rows).withColumn("channel", F.lit(c))
        out = part if out is None else out.unionByName(part)
    return out


def send_in_halves(batch: Sequence[T], send: Callable[[Sequence[T]], None], refused: type[Exception] | tuple[type[Exception], ...] = (TimeoutError, ConnectionError), parts: int = 16) -> None:
    """Send a batch; where the store refuses it, its halves, down to a ``parts``-th of it."""
    least, todo = max(1, len(batch) // parts), [batch]
    while todo:
        now = todo.pop(0)
        try:
            send(now)
        except refused:
            if len(now) // 2 < least:
                raise
            todo[:0] = [now[: len(now) // 2], now[len(now) // 2 :]]


def forget(tables: dict[str, DataFrame], request: DataFrame, journal: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables without the documents of ``request`` (KEY) and of requests that an earlier run left in ``journal``, by stage in order.

    ``journal`` has a row (KEY, stage) for each stage that is not known to be done.
    """
    gone = request.select(*KEY)
    if journal is not None:
        gone = gone.unionByName(journal.select(*KEY))
    gone = gone.distinct()
    return {s: tables[s].join(gone, KEY, "left_anti") for s in FORGET_STAGES if s in tables}


def left_to_forget(log: DataFrame) -> DataFrame:
    """Requests of a log (line_no, KEY, stage, status) that are not finished, with the stages still to do; the last line of a stage counts."""
    last = log.groupBy(*KEY, "stage").agg(F.max_by("status", "line_no").alias("status"))
    done = F.collect_set(F.when(F.col("status") == "done", F.col("stage")))
    todo = F.array_except(F.array(*map(F.lit, FORGET_STAGES)), F.coalesce("done", F.array().cast("array<string>")))
    return last.groupBy(*KEY).agg(done.alias("done")).withColumn("stages", todo).filter(F.size("stages") > 0).select(*KEY, "stages")


def torn_writes(log: DataFrame) -> DataFrame:
    """Documents whose last write in a log (line_no, KEY, status) was begun and not committed: their points are purged before the next ingest."""
    return log.groupBy(*KEY).agg(F.max_by("status", "line_no").alias("status"), F.max("line_no").alias("line_no")).filter("status = 'begun'").drop("status")


def context_cache(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """Asked contexts (document_sha256, chunk_sha256, contextualizer) with the cached one; ``hit`` says if there is any, each asked once."""
    keys = ["document_sha256", "chunk_sha256", "contextualizer"]
    return asked.select(*keys).distinct().join(cache.select(*keys, "context"), keys, "left").withColumn("hit", F.col("context").isNotNull())


def append_if_stale(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries (KEY, content_sha256) that the manifest does not already end with for their document: the lines to append."""
    last = manifest.groupBy(*KEY).agg(F.max_by("content_sha256", "line_no").alias("_last"))
    return entries.join(last, KEY, "left").filter(~F.col("content_sha256").eqNullSafe(F.col("_last"))).drop("_last")


def repaired_manifest(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """The manifest with what the store knows of its documents: counts and hashes are the store's, documents that only the store has are added."""
    r = records.select(*KEY, F.col("chunk_count").alias("_n"), F.col("content_sha256").alias("_h"))
    both = manifest.join(r, KEY, "full")
    changed = (F.col("_n").isNotNull() & ~F.col("chunk_count").eqNullSafe(F.col("_n"))) | (F.col("_h").isNotNull() & ~F.col("content_sha256").eqNullSafe(F.col("_h")))
    return both.select(*KEY, F.coalesce("_n", "chunk_count").alias("chunk_count"), F.coalesce("_h", "content_sha256").alias("content_sha256"), changed.alias("repaired"))


def sidecar_records(points: DataFrame) -> DataFrame:
    """The lexical sidecar's rows of indexed points: what a search returns of them, with score zero."""
    return points.filter(F.trim("text") != "").withColumn("score", F.lit(0.0))


def ingest_plan(items: DataFrame, manifest: DataFrame) -> DataFrame:
    """What an ingest of ``items`` (document_key, content_sha256) would do, without doing it: create, replace, skip, or remove what is no longer there."""
    m = manifest.select("document_key", F.col("content_sha256").alias("_known"))
    both = items.join(m, "document_key", "full")
    action = F.when(F.col("content_sha256").isNull(), "remove").when(F.col("_known").isNull(), "create").when(F.col("_known") == F.col("content_sha256"), "skip").otherwise("replace")
    return both.select("document_key", action.alias("action"))


def manifest_preview(chunks: DataFrame) -> DataFrame:
    """Manifest entries of prepared chunks that were not indexed: chunks and characters by document, in state preview."""
    return chunks.groupBy(*KEY).agg(F.count(F.lit(1)).alias("chunk_count"), F.sum(F.length("text")).cast("long").alias("chars")).withColumn("state", F.lit("preview"))


def kept_jobs(jobs: DataFrame, now: Column, ttl_seconds: int, most: int) -> DataFrame:
    """Jobs (job_id, owner, status, updated_at) to keep: those that run, and an owner's ``most`` latest finished ones within the time to live."""
    ended = F.col("status").isin("succeeded", "failed")
    place = F.row_number().over(Window.partitionBy("owner", ended).orderBy(F.desc("updated_at"), "job_id"))
    fresh = F.col("updated_at") >= now - F.make_dt_interval(secs=F.lit(ttl_seconds))
    return jobs.withColumn("_n", place).filter(~ended | (fresh & (F.col("_n") <= most))).drop("_n")
