"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has the majority bits of the XXH64 hashes of a text's word
shingles. Two fingerprints that differ in at most ``radius`` bits agree in two of
``radius + 2`` blocks of bits, so every such pair meets in a bucket of one of the
block pairs (15 for the usual radius 4). Within buckets, fingerprints are held as
64 vertical bit planes: the distances of all neighbours at a given shift are
counted at once, 64 to a machine word, with carry-save counters, and words leave
the computation once all their lanes exceed the radius. A bucket gives a spanning
forest, not its pairs; components of these links are then found by table rounds.

Buckets above ``block_rows`` fingerprints are cut into blocks by hash, and each
pair of blocks is a task of its own; the result is the same.

Defined results: a null or wordless text has fingerprint zero and is linked like
any other; repeated rows are linked with each other; a null id counts as no id
when the least id of a component is taken; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.components import stars
from corvane.llm.scratch import drop, store
from corvane.llm.tables import fewer_files, row_key, whole_rows

ONE = np.uint64(1)


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text; A-Z count as lower case."""
    from xxhash import xxh64_intdigest

    found = (text or b"").lower().split()
    if not found:
        return 0
    body = b" ".join(found)
    if len(found) <= shingle:
        return xxh64_intdigest(body, 42)
    gaps = np.flatnonzero(np.frombuffer(body, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(body)][shingle - 1 :]
    total, n = np.zeros(64, np.int64), len(ends)
    for at in range(0, n, 1 << 16):
        h = np.array([xxh64_intdigest(body[a:b], 42) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=False)], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def bucket_keys(fp: Column, radius: int) -> Column:
    """One long for each pair of blocks: the pair's number and the bits of both blocks."""
    n = radius + 2
    cuts = [64 * k // n for k in range(n + 1)]

    def block(k: int) -> Column:
        return F.shiftrightunsigned(fp, cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1))

    keys = [F.shiftleft(F.lit(at).cast("long"), 40).bitwiseOR(F.shiftleft(block(i), 20).bitwiseOR(block(j))) for at, (i, j) in enumerate(combinations(range(n), 2))]
    return F.array(*keys)


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Vertical planes: row k holds bit k of all fingerprints, 64 to a word, and one spare word."""
    words = -(-len(fps) // 64) + 1
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def beyond(c1: np.ndarray, c2: np.ndarray, c4: np.ndarray, over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter exceeds ``radius`` (0 to 7)."""
    more, same = over.copy(), ~over
    for bit, c in ((4, c4), (2, c2), (1, c1)):
        if radius & bit:
            same &= c
        else:
            more |= same & c
            same &= ~c
    return more


def join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the sets of a[i] and b[i]; the least member stays root."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def linked(ends: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """Root of each fingerprint among those of its bucket; ``ends[i]`` is where the bucket of i ends.

    At shift s, lane i holds the distance of fingerprints i and i + s. Lanes of
    different buckets and of pairs already joined are not computed.
    """
    n = len(fps)
    root, planes = np.arange(n), planes_of(fps)
    live = np.flatnonzero(np.arange(n) + 1 < ends)
    s = 1
    while len(live):
        use = live[root[live] != root[live + s]]
        if len(use):
            mask = np.zeros(planes.shape[1] * 64, bool)
            mask[use] = True
            lanes = np.packbits(mask, bitorder="little").view("<u8")
            at = np.flatnonzero(lanes)
            lanes = lanes[at]
            q, r = at + s // 64, np.uint64(s % 64)
            nxt = np.minimum(q + 1, planes.shape[1] - 1)
            c1, c2, c4, over = (np.zeros(len(at), np.uint64) for _ in range(4))
            for k in range(64):
                p = planes[k]
                other = p[q] if not r else (p[q] >> r) | (p[nxt] << (np.uint64(64) - r))
                x = p[at] ^ other
                t = c1 & x
                c1 ^= x
                u = c2 & t
                c2 ^= t
                over |= c4 & u
                c4 ^= u
                if k % 8 == 7:
                    dead = beyond(c1, c2, c4, over, radius)
                    keep = (lanes & ~dead) != 0
                    if not keep.any():
                        at = at[:0]
                        break
                    if k < 63 and keep.sum() * 4 < len(keep) * 3:
                        at, q, nxt, lanes, c1, c2, c4, over = (v[keep] for v in (at, q, nxt, lanes, c1, c2, c4, over))
            if len(at):
                close = lanes & ~beyond(c1, c2, c4, over, radius)
                hit = np.flatnonzero(np.unpackbits(close.view(np.uint8), bitorder="little"))
                i = at[hit // 64] * 64 + hit % 64
                join_roots(root, i, i + s)
        s += 1
        live = live[live + s < ends[live]]
    return root


def bucket_edges(keyed: DataFrame, radius: int) -> DataFrame:
    """Rows (key, part, fp) -> (a, b): each fingerprint with the least position it is linked to in its bucket."""

    def forest(key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True])
        ends = np.repeat(cut[1:], np.diff(cut))
        root = linked(ends, fps, radius)
        far = np.flatnonzero(root != np.arange(len(root)))
        return pa.record_batch([pa.array(fps[far].view(np.int64)), pa.array(fps[root[far]].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fps = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate([key, np.stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)], axis=1)])
            fps = np.concatenate([fps, batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(fps) >= 400_000:
                whole = np.flatnonzero((key != key[-1]).any(axis=1))
                if len(whole):
                    yield forest(key[: whole[-1] + 1], fps[: whole[-1] + 1])
                    key, fps = key[whole[-1] + 1 :], fps[whole[-1] + 1 :]
        if len(fps):
            yield forest(key, fps)

    return keyed.repartition("key", "part").sortWithinPartitions("key", "part").select("key", "part", "fp").mapInArrow(run, "a bigint, b bigint")


def fingerprint_links(fps: DataFrame, radius: int = 4, block_rows: int = 4096) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that span every component of the radius graph."""
    keyed = fps.select("fp", F.explode(bucket_keys(F.col("fp"), radius)).alias("key"))
    large = store(fewer_files(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_rows)), "large")
    if large.isEmpty():
        parts = keyed.withColumn("part", F.lit(0).cast("long"))
    else:
        c = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / block_rows)
        own = F.pmod(F.xxhash64("fp"), c)
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), c - 1), lambda x: F.shiftleft(F.least(x, own), 31).bitwiseOR(F.greatest(x, own)))
        parts = keyed.join(large, "key", "left").select("fp", "key", F.explode(pairs).alias("part"))
    links = store(fewer_files(bucket_edges(parts, radius)), "links")
    drop(large)
    return links


def fingerprint_roots(fps: DataFrame, radius: int = 4, block_rows: int = 4096) -> DataFrame:
    """Distinct fingerprints (fp, ...) with ``root``, one fingerprint for each component of the radius graph."""
    links = fingerprint_links(fps.select("fp"), radius, block_rows)
    roots = stars(links)
    drop(links)
    rooted = store(fewer_files(fps.join(roots.select(F.col("a").alias("fp"), F.col("b").alias("to")), "fp", "left").withColumn("root", F.coalesce("to", "fp")).drop("to")), "roots")
    drop(roots)
    return rooted


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4, block_rows: int = 4096) -> DataFrame:
    """Per row of ``docs``: id, fp (signed long) and component (least id reachable by links)."""
    marked = store(with_fingerprints(docs, id_col, text, shingle), "fingerprints")
    fps = store(fewer_files(marked.groupBy("fp").agg(F.min("id").alias("least"))), "distinct")
    rooted = fingerprint_roots(fps, radius, block_rows)
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of_fp = store(fewer_files(rooted.join(named, "root").select("fp", "component")), "components")
    drop(fps, rooted)
    return marked.join(of_fp, "fp").select("id", "fp", "component")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4, block_rows: int = 4096) -> DataFrame:
    """Rows of ``docs``: of each component the one with the least id, of repeated rows any one.

    Rows are told apart by id and text, so one id may head several components. Rows
    without an id come after all others: a component keeps one only if none has an id.
    The table of heads grows with the input, so it is merged by key at any size and
    never broadcast.
    """
    key = row_key(F.col(id_col), F.col(text)).alias("key")
    rows = docs.select(F.struct(F.col(id_col).alias("id"), key).alias("row"), F.col(text).alias("text"))
    marked = store(with_fingerprints(rows, "row", "text", shingle), "fingerprints")
    fps = store(fewer_files(marked.select("fp").distinct()), "distinct")
    rooted = fingerprint_roots(fps, radius, block_rows)
    counted = marked.groupBy("fp", "id").agg(F.count(F.lit(1)).alias("n")).join(rooted, "fp")
    first = F.min(F.struct(F.col("id.id").isNull().alias("none"), F.col("id.id").alias("id"), F.col("id.key").alias("key"), "n")).alias("first")
    heads = store(fewer_files(counted.groupBy("root").agg(first).select("first.key", "first.n")), "heads")
    drop(marked, fps, rooted)
    kept = whole_rows(docs, key).join(heads.hint("merge"), "key")
    single = kept.filter("n = 1").select("row.*")
    if heads.filter("n > 1").isEmpty():
        return single
    return single.unionByName(kept.filter("n > 1").dropDuplicates(["key"]).select("row.*"))
