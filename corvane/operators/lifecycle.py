"""Index lifecycle: upserts, stale rows, ingest decisions, manifests, journals, caches.

Tables are plain DataFrames; a caller writes the result to a new place and swaps it
in (:func:`swap_in`), so a job that dies leaves the old table whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REASONS = {
    "unchanged": "content_sha256_match", "changed": "content_sha256_changed", "missing": "source_not_in_manifest",
    "orphaned": "manifest_entry_without_source", "duplicate": "duplicate_manifest_document_key",
}


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row with the highest ``order`` of each key; its columns stay."""
    cols = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in cols]).select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """``new`` rows in place of ``old`` ones of the same key; of new rows with one key the last by ``order`` wins."""
    if order is not None:
        new = latest(new, [key], order).drop(order)
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def stale_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(document_id, chunk_index) from the new count up to the old one; tables have document_id and chunk_count."""
    both = old.select("document_id", F.col("chunk_count").alias("was")).join(new.select("document_id", F.col("chunk_count").alias("now")), "document_id")
    return both.filter("was > now").select("document_id", F.explode(F.sequence(F.col("now"), F.col("was") - 1)).alias("chunk_index"))


def replace_documents(points: DataFrame, new_points: DataFrame, touched: DataFrame) -> DataFrame:
    """Points of documents in ``touched`` give way to ``new_points``; a touched document without any is deleted."""
    return points.join(touched.select("document_id").distinct(), "document_id", "left_anti").select(*points.columns).unionByName(new_points.select(*points.columns))


def ingest_state(incoming: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Rows of ``incoming`` (document_id, content_sha256, version, fingerprint) with state and should_index.

    created, replaced (other content), reindexed (same content; forced, other version or
    other known fingerprint), unchanged.
    """
    s = stored.select("document_id", *[F.col(c).alias(f"_{c}") for c in ("content_sha256", "version", "fingerprint")], F.lit(True).alias("_known"))
    other = ~F.col("version").eqNullSafe(F.col("_version")) | F.coalesce(F.col("fingerprint") != F.col("_fingerprint"), F.lit(False))
    state = F.when(F.col("_known").isNull(), "created").when(~F.col("content_sha256").eqNullSafe(F.col("_content_sha256")), "replaced").when(F.lit(force) | other, "reindexed").otherwise("unchanged")
    return incoming.join(s, "document_id", "left").withColumn("state", state).withColumn("should_index", F.col("state") != "unchanged").select(*incoming.columns, "state", "should_index")


def document_records(points: DataFrame) -> DataFrame:
    """One row a document of a points table, with the number of its chunks."""
    return points.groupBy("namespace", "collection", "document_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.min("title").alias("title"))


def reconcile(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Manifest entries (document_key, document_id, content_sha256) against sources (document_key, content_sha256).

    Every entry of a key that the manifest has twice is ``duplicate``; then
    unchanged, changed, missing (no entry) and orphaned (no source). A hash that is
    null on either side can't tell a change.
    """
    e = entries.select(F.col("document_key"), "document_id", F.col("content_sha256").alias("manifest_content_sha256"), F.count(F.lit(1)).over(Window.partitionBy("document_key")).alias("_n"))
    s = sources.select(F.col("document_key").alias("_k"), F.col("content_sha256").alias("source_content_sha256"), F.lit(True).alias("_s"))
    both = e.join(s, F.col("document_key") == F.col("_k"), "full_outer")
    changed = F.coalesce(F.col("manifest_content_sha256") != F.col("source_content_sha256"), F.lit(False))
    status = F.when(F.col("_n") > 1, "duplicate").when(F.col("_n").isNull(), "missing").when(F.col("_s").isNull(), "orphaned").when(changed, "changed").otherwise("unchanged")
    unchecked = F.col("manifest_content_sha256").isNull() | F.col("source_content_sha256").isNull()
    reason = F.when((F.col("status") == "unchanged") & unchecked, "present_without_hash_check").otherwise(F.element_at(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv]), F.col("status")))
    return both.withColumn("status", status).withColumn("reason", reason).select("status", F.coalesce("document_key", "_k").alias("document_key"), "document_id", "manifest_content_sha256", "source_content_sha256", "reason", F.col("status").isin("missing", "changed").alias("needs_reindex"))


def compact_manifest(lines: DataFrame) -> DataFrame:
    """Latest line of each document; a document goes once a later line of another one takes over its key."""
    now = latest(lines, ["document_id"], "line_no")
    owner = lines.groupBy("document_key").agg(F.max_by("document_id", "line_no").alias("_owner"))
    return now.join(owner, "document_key").filter(F.col("document_id") == F.col("_owner")).select(*lines.columns)


def collection_rollup(entries: DataFrame) -> DataFrame:
    return entries.groupBy("namespace", "collection").agg(F.count(F.lit(1)).alias("documents"), F.sum("chunk_count").alias("chunks"), F.array_sort(F.collect_set("parser")).alias("parsers"))


# Metadata keys that may carry a provider's messages.
UNSAFE_METADATA = (
    "converter_error", "error", "error_message", "exception", "exception_message", "parse_error", "parser_error",
    "provider_error", "quality_details", "raw_error", "stack_trace", "stacktrace", "traceback",
)


def safe_metadata(metadata: Column) -> Column:
    """A string map without keys that are not for a manifest."""
    return F.map_filter(metadata, lambda k, v: ~k.isin(*UNSAFE_METADATA))


def page_indices(pages: Column, most: int = 400) -> Column:
    """Distinct page numbers from 0 on, in order, ``most`` at most: a manifest field's own limit."""
    return F.slice(F.array_distinct(F.filter(pages, lambda p: p >= 0)), 1, most)


def pending(journal: DataFrame, key: list[str], done: str = "committed") -> DataFrame:
    """Journal rows whose key's last line is not ``done``."""
    return latest(journal, key, "line_no").filter(F.col("status") != done)


def embedding_cache(requests: DataFrame, cache: DataFrame, dimension: int) -> DataFrame:
    """Per distinct key of ``requests``: how often it is asked for, its cached vector and whether that is a hit; a vector that is not valid is a miss."""
    from corvane.functions.vectors import valid_vector

    asked = requests.groupBy("key").agg(F.count(F.lit(1)).alias("requests"))
    return asked.join(cache.select("key", "vec"), "key", "left").withColumn("hit", valid_vector(F.col("vec"), dimension))


def evict(cache: DataFrame, max_entries: int, oldest: Column | None = None) -> DataFrame:
    """Cache rows newer than ``oldest``, the newest ``max_entries`` of them (by ts, then key, both falling): the cache's own bound."""
    live = cache if oldest is None else cache.filter(F.col("ts") > oldest)
    return live.orderBy(F.desc("ts"), F.desc("key")).limit(max_entries)


def split_results(rows: DataFrame) -> DataFrame:
    """Ingest outcomes: counts by status."""
    return rows.agg(
        F.count(F.lit(1)).alias("planned"), F.count_if(F.col("status").isin("written", "skipped")).alias("succeeded"), F.count_if(F.col("status") == "written").alias("written"),
        F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "failed").alias("failed"),
    )


def batch_progress(events: DataFrame, batch: str, order: str) -> DataFrame:
    """Running counters of a batch's items after each event."""
    w = Window.partitionBy(batch).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.select(batch, order, "status", F.count(F.lit(1)).over(w).alias("completed"), F.sum((F.col("status") != "failed").cast("long")).over(w).alias("succeeded"), F.sum((F.col("status") == "failed").cast("long")).over(w).alias("failed"))


def swap_in(df: DataFrame, path: str) -> None:
    """Write ``df`` beside ``path`` and put it there by renames, by the file system that Spark knows."""
    spark = df.sparkSession
    new, old = f"{path}.new", f"{path}.old"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(hadoop(new), True)
    df.write.parquet(new)
    fs.delete(hadoop(old), True)
    if fs.exists(hadoop(path)):
        fs.rename(hadoop(path), hadoop(old))
    fs.rename(hadoop(new), hadoop(path))
    fs.delete(hadoop(old), True)


def recover_swap(spark, path: str) -> None:
    """After a job that died between two renames: the old table returns; an unfinished new one goes."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop(path)) and fs.exists(hadoop(f"{path}.old")):
        fs.rename(hadoop(f"{path}.old"), hadoop(path))
    fs.delete(hadoop(f"{path}.new"), True)


def swap_buckets(df: DataFrame, path: str, bucket: str = "bucket") -> None:
    """Put the buckets that ``df`` holds in place of those of the same number at ``path``; the others stay untouched.

    New buckets are written in one job under ``_new``, which readers pass over, and
    moved one by one, the old one to ``_old`` first. One writer at a time.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    df.repartition(bucket).write.partitionBy(bucket).parquet(f"{path}/_new")
    for f in fs.listStatus(hadoop(f"{path}/_new")):
        name = f.getPath().getName()
        if f.isDirectory() and name.startswith(f"{bucket}="):
            if fs.exists(hadoop(f"{path}/{name}")):
                fs.mkdirs(hadoop(f"{path}/_old"))
                fs.rename(hadoop(f"{path}/{name}"), hadoop(f"{path}/_old/{name}"))
            fs.rename(hadoop(f"{path}/_new/{name}"), hadoop(f"{path}/{name}"))
    fs.delete(hadoop(f"{path}/_new"), True)
    fs.delete(hadoop(f"{path}/_old"), True)


def recover_buckets(spark, path: str) -> bool:
    """After a job that died on the way: buckets that were taken away and not replaced return. Whether there is a table at all."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop(path)):
        return False
    if fs.exists(hadoop(f"{path}/_old")):
        for f in fs.listStatus(hadoop(f"{path}/_old")):
            name = f.getPath().getName()
            if not fs.exists(hadoop(f"{path}/{name}")):
                fs.rename(hadoop(f"{path}/_old/{name}"), hadoop(f"{path}/{name}"))
        fs.delete(hadoop(f"{path}/_old"), True)
    fs.delete(hadoop(f"{path}/_new"), True)
    return any(f.isDirectory() for f in fs.listStatus(hadoop(path)))
