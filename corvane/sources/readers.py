"""Readers: folders, archives, URL lists, JSON-lines manifests, cases and event logs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.urls import document_key
from corvane.operators.convert import BY_EXTENSION, REFUSED, extension

CASES = (
    "case_id STRING, query STRING, namespace STRING, collections ARRAY<STRING>, expected_ids ARRAY<STRING>, expected_grades MAP<STRING,INT>, expected_context_contains ARRAY<STRING>, forbidden_context_contains ARRAY<STRING>, "
    "expected_citation_count_min INT, expected_source_count_min INT, max_context_chars INT, max_context_tokens INT, document_ids ARRAY<STRING>, forbidden_ids ARRAY<STRING>, expect_no_results BOOLEAN"
)
MANIFEST = "document_id STRING, namespace STRING, collection STRING, document_key STRING, content_sha256 STRING, filename STRING, mime_type STRING, chunk_count INT, parser STRING, needs_ocr BOOLEAN, metadata MAP<STRING,STRING>"
EVENTS = "event_type STRING, search_id STRING, started_at_ns BIGINT, stage STRING, succeeded BOOLEAN, attempted_rerank BOOLEAN, applied_rerank BOOLEAN, error_type STRING, duration_ms DOUBLE, result_count INT, provider STRING"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files(spark: SparkSession, root: str, pattern: str = "*", content: bool = True) -> DataFrame:
    """Supported files below ``root``: document_key, name, path, length, content_sha256 and content.

    Lock files, caches and formats without a converter are left out. Listing and
    reading are Spark's, so any file system that it knows will do; links are whatever
    that file system makes of them, and a local caller runs :func:`local_paths` first.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    known = extension(F.col("name")).isin(*BY_EXTENSION) & ~extension(F.col("name")).isin(*REFUSED)
    kept = rows.withColumn("name", name).filter(known & ~F.startswith("name", F.lit("~$")) & ~F.contains("path", F.lit("/__pycache__/")))
    relative = F.regexp_replace(F.col("path"), "^.*?" + _quoted(root.rstrip("/").split("://")[-1]) + "/", "")
    key = F.concat(F.lit("local:"), relative, F.lit("#source:" + hashlib.sha256(root.encode()).hexdigest()[:16]))
    out = kept.select(key.alias("document_key"), "name", "path", "length", F.sha2("content", 256).alias("content_sha256"), *(["content"] if content else []))
    return out


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def local_paths(root: str, max_files: int = 200) -> tuple[list[str], dict[str, int]]:
    """Paths of supported local files for a small interactive search, with counts of what was left out.

    Links and files that lead out of ``root`` are refused; a file that has two names
    counts once; ``truncated`` tells that there were more than ``max_files``.
    """
    import os

    found, seen, left = [], set(), {"ignored": 0, "empty": 0, "unsupported": 0, "truncated": 0}
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and d != "__pycache__")
        for n in sorted(names):
            path = os.path.join(folder, n)
            s = os.lstat(path)
            if n.startswith((".", "~$")) or n.endswith(".pyc") or os.path.islink(path) or (s.st_dev, s.st_ino) in seen:
                left["ignored"] += 1
            elif n.rpartition(".")[2].lower() not in BY_EXTENSION:
                left["unsupported"] += 1
            elif not s.st_size:
                left["empty"] += 1
            elif len(found) >= max_files:
                left["truncated"] = 1
            else:
                seen.add((s.st_dev, s.st_ino))
                found.append(path)
    return found, left


@dataclass(frozen=True)
class ZipLimits:
    entries: int = 1000
    entry_bytes: int = 50 << 20
    total_bytes: int = 250 << 20


def safe_member(name: str) -> bool:
    parts = name.replace("\\", "/").split("/")
    return not (name.startswith(("/", "\\")) or ":" in parts[0] or ".." in parts or not parts[-1])


def zip_members(archives: DataFrame, limits: ZipLimits = ZipLimits()) -> DataFrame:
    """Members of ZIP files (path, content): path, member, content_sha256, content, error.

    An archive beyond a limit, with two members of one name or an unsafe name is one
    row with an error and no content: nothing of it is used.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for f in frames:
            for path, raw in zip(f["path"], f["content"], strict=True):
                rows = []
                try:
                    z = zipfile.ZipFile(io.BytesIO(raw))
                    infos = [i for i in z.infolist() if not i.is_dir()]
                    if len(infos) > limits.entries or sum(i.file_size for i in infos) > limits.total_bytes or any(i.file_size > limits.entry_bytes for i in infos):
                        raise ValueError("beyond the limits")
                    if len({i.filename for i in infos}) < len(infos) or not all(safe_member(i.filename) for i in infos):
                        raise ValueError("duplicate or unsafe names")
                    for i in infos:
                        with z.open(i) as m:
                            body = m.read(limits.entry_bytes + 1)
                        if len(body) != i.file_size:
                            raise ValueError("a member is not of the size it claims")
                        rows.append((path, i.filename, hashlib.sha256(body).hexdigest(), body, None))
                except Exception as e:
                    rows = [(path, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["path", "member", "content_sha256", "content", "error"])

    return archives.select("path", "content").mapInPandas(run, "path string, member string, content_sha256 string, content binary, error string")


def planned_members(archives: DataFrame, plan: DataFrame, limits: ZipLimits = ZipLimits()) -> DataFrame:
    """Members that were planned (path, member, content_sha256), read again: one that is gone or has changed since has an error and no content."""
    now = zip_members(archives, limits).select("path", "member", F.col("content_sha256").alias("_sha"), "content", F.col("error").alias("_error"))
    broken = now.filter("member is null").select("path", F.col("_error").alias("_broken"))
    both = plan.join(now.filter("member is not null"), ["path", "member"], "left").join(broken, "path", "left")
    same = F.col("_sha") == F.col("content_sha256")
    error = F.when(F.col("_broken").isNotNull(), F.col("_broken")).when(F.col("_sha").isNull(), "member not found").when(~same, "member changed after planning")
    return both.select("path", "member", "content_sha256", F.when(same, F.col("content")).alias("content"), error.alias("error"))


def url_list(spark: SparkSession, path: str, most: int = 10_000) -> DataFrame:
    """URLs of a text file, one a line, with their document keys; comments and blank lines are skipped, two URLs of one key refused."""
    rows = spark.read.text(path).select(F.trim("value").alias("url")).filter("url <> '' and not startswith(url, '#')").withColumn("document_key", document_key(F.col("url")))
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("document_key").alias("d")).first()
    if n.n > most or n.d < n.n:
        raise ValueError("too many URLs, or two with one key")
    return rows


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file with their order in ``line_no``."""
    rows = spark.read.text(path).filter("trim(value) <> ''").withColumn("line_no", F.monotonically_increasing_id())
    return rows.select(F.from_json("value", schema).alias("r"), "line_no").select("r.*", "line_no")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The latest line of each document."""
    from corvane.operators.lifecycle import latest

    return latest(json_lines(spark, path, MANIFEST), ["document_id"], "line_no")


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases; raises if ids repeat, expected ids and no results disagree, or grades and expected ids do."""
    rows = json_lines(spark, path, CASES)
    rows = rows.withColumn("case_id", F.coalesce("case_id", F.concat(F.lit("case-"), F.row_number().over(Window.orderBy("line_no")).cast("string"))))
    none = F.coalesce(F.size(F.nullif("expected_ids", F.array().cast("array<string>"))), F.lit(0)) <= 0
    bad = none != F.coalesce("expect_no_results", F.lit(False))
    positive = F.map_keys(F.map_filter("expected_grades", lambda k, v: v > 0))
    wrong = F.col("expected_grades").isNotNull() & (F.array_sort(positive) != F.array_sort("expected_ids"))
    repeated = F.size(F.array_distinct("expected_ids")) < F.size("expected_ids")
    found = rows.agg(F.count_if(bad | F.coalesce(wrong, F.lit(False)) | F.coalesce(repeated, F.lit(False))).alias("bad"), (F.count(F.lit(1)) - F.count_distinct("case_id")).alias("twice")).first()
    if found.bad or found.twice:
        raise ValueError(f"{found.bad} cases contradict themselves, {found.twice} ids repeat")
    return rows


def events(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, EVENTS).withColumnRenamed("line_no", "seq")


def chunks_by_index(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks of (document_id, chunk_index) rows, in order within each document."""
    return points.join(wanted.select("document_id", "chunk_index").distinct(), ["document_id", "chunk_index"], "left_semi")
