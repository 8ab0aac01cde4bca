"""Exact substring deduplication with per-shard suffix arrays.

A byte goes if a string of ``length`` (100) bytes that covers it also starts
earlier in the corpus. The steps, each a table in the shared folder:

1. Texts are laid out in ascending id order in chunks, so that (chunk, offset)
   orders all bytes.
2. Each window of 100 bytes elects an anchor: the least-hashed 32-gram in it.
   Equal windows elect equal anchors, and an anchor stands for a run of windows.
   Only anchors that occur twice in the corpus can head a repeated window; of an
   anchor, each chunk sends one hash however often it occurs.
3. Windows of repeated anchors are routed to shards by anchor, equal contexts
   once a chunk, and each shard sorts what is left with a suffix array
   (Larsson-Sadakane refinement by doubling, in numpy) and common prefixes by
   Kasai's rule; suffixes that share 100 bytes form a class, and all of a class
   but the earliest go. Contexts that are equal as a whole are one before that: they
   are found by hash and verified byte by byte.
4. Anchors with more than ``hot`` occurrences are spread over several shards.
   Their classes are merged across shards: sorted lists of class heads, dealt by
   content, are merged by binary search, two by two in rounds, and the later head goes.

What shards and chunks send each other is packed by groups of 16 chunks of a
partition, so its rows are as many as groups times shards, not chunks times shards.

Defined results: a null text has no bytes; texts shorter than 100 bytes lose
nothing; rows of equal id lie in the order of their texts' hashes, and the first
of identical rows stays; a null id sorts first; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.scratch import drop, free_shuffles, store
from corvane.llm.tables import fewer_files, parts_for

GRAM = 32
GROUP = 4  # bits of a chunk's number that tell its place in its group
_TABLE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all 32-grams, by doubling."""
    h, step = _TABLE[data], 1
    for m in _MIX:
        a = h[: len(h) - step] * m
        a ^= a >> np.uint64(29)
        a += h[step:]
        h, step = a, step * 2
    h *= _MIX[0]
    h ^= h >> np.uint64(32)
    return h


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        v = np.minimum(v[: len(v) - have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (width - have)], v[width - have :]) if have < width else v


def anchors(data: np.ndarray, ends: np.ndarray, length: int, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, hash) of the windows' runs in texts that end at ``ends``."""
    valid = np.ones(len(data), bool)
    for e in ends.tolist():
        valid[max(e - length + 1, 0) : e] = False
    low = np.uint64(0xFFFFFF)
    out: list[list[np.ndarray]] = [[], [], [], []]
    for b in range(0, max(len(data) - length + 1, 0), block):
        part = data[b : b + block + length - 1]
        h = gram_hashes(part)
        sel = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        least = sliding_min(sel, length - GRAM + 1)
        p = np.flatnonzero(valid[b : b + len(least)])
        if not len(p):
            continue
        a = (least[p] & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)])
        last = np.r_[first[1:], len(p)] - 1
        for x, v in zip(out, (a[first] + b, p[first] + b, p[last] + b, h[a[first]]), strict=True):
            x.append(v)
    kinds = (np.int64, np.int64, np.int64, np.uint64)
    return tuple(np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, kinds, strict=True))


def suffix_ranks(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) of ``text`` (values below 257) by the first ``length`` values.

    Larsson-Sadakane: order by a short prefix, then refine only the groups that
    are still unsorted, by the rank of the suffix ``h`` further on, doubling ``h``.
    """
    n = len(text)
    key = np.zeros(n, np.int64)
    pad = np.concatenate([text.astype(np.int64) + 1, np.zeros(7, np.int64)])
    for k in range(7):
        key = key * 258 + pad[k : k + n]
    sa = np.argsort(key)
    new = np.r_[True, key[sa[1:]] != key[sa[:-1]]] if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    head = np.flatnonzero(new)
    rank[sa] = np.repeat(head, np.diff(np.r_[head, n]))
    h = 7
    while h < length:
        step = min(h, length - h)  # the last step may overlap what is known
        size = np.diff(np.r_[head, n])
        open_ = np.repeat(size > 1, size)
        at = np.flatnonzero(open_)
        if not len(at):
            break
        s = sa[at]
        ahead = np.where(s + step < n, rank[np.minimum(s + step, n - 1)] + 1, 0)
        both = rank[s] * (n + 1) + ahead
        order = np.argsort(both)
        s, both = s[order], both[order]
        sa[at] = s
        begins = np.r_[True, both[1:] != both[:-1]]
        b = np.flatnonzero(begins)
        rank[s] = np.repeat(at[b], np.diff(np.r_[b, len(s)]))
        new[at] = begins
        head = np.flatnonzero(new)
        h += step
    return sa, rank


def common_prefixes(text: np.ndarray, sa: np.ndarray, cap: int, lanes: int = 1 << 16) -> np.ndarray:
    """Kasai: common prefix (up to ``cap``) of each suffix in ``sa`` order with its predecessor.

    In text order a prefix shrinks by one at most from a position to the next, as
    long as the predecessor's next suffix also precedes this position's next one;
    as ``sa`` orders by a bounded prefix only, that is looked up, and the count
    starts anew where it fails. The text is cut into ``lanes`` stretches that
    advance side by side.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    order = np.empty(n + 1, np.int64)
    order[sa], order[n] = np.arange(n), n
    pad = np.concatenate([text.astype(np.int32), -1 - np.arange(cap + 1, dtype=np.int32)])
    plcp = np.zeros(n, np.int64)
    width = -(-n // lanes)
    first = np.arange(0, n, width)
    have = np.zeros(len(first), np.int64)
    for t in range(width):
        i = first + t
        i = i[i < n]
        have = np.maximum(have[: len(i)] - 1, 0)
        if t:
            have[order[before[i - 1] + 1] >= order[i]] = 0
        j = before[i]
        have[j < 0] = 0
        go = np.flatnonzero((j >= 0) & (have < cap))
        while len(go):
            a, b = i[go] + have[go], j[go] + have[go]
            same = (pad[np.minimum(a, n + cap)] == pad[np.minimum(b, n + cap)]) & (a < n) & (b < n)
            go = go[same]
            have[go] += 1
            go = go[have[go] < cap]
        plcp[i] = have
    return plcp[sa]


def row_groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of first equal row, is it itself) of each row of bytes; hashes are verified."""
    n, w = rows.shape
    wide = np.zeros((n, -(-w // 8) * 8), np.uint8)
    wide[:, :w] = rows
    h = np.zeros(n, np.uint64)
    for k, col in enumerate(wide.view("<u8").T):
        h = (h ^ col) * _MIX[k % 5]
        h ^= h >> np.uint64(31)
    _, index, back = np.unique(h, return_index=True, return_inverse=True)
    rep = index[back]
    wrong = (rows != rows[rep]).any(axis=1)
    rep[wrong] = np.flatnonzero(wrong)
    return rep, rep == np.arange(n)


def runs_of(chunk: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows at (chunk, at) -> chunk, start and stop of the stretches they cover, in order."""
    order = np.lexsort((at, chunk))
    chunk, at = chunk[order], at[order]
    cut = np.flatnonzero(np.r_[True, (np.diff(at) > 1) | (np.diff(chunk) != 0)]) if len(at) else np.zeros(0, np.int64)
    return chunk[cut], at[cut], at[np.r_[cut[1:], len(at)].astype(np.int64)[: len(cut)] - 1] + length


def shard_classes(lo: np.ndarray, hi: np.ndarray, ctx: np.ndarray, chunk: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of a shard's distinct contexts, class by class in corpus order.

    Returns records, window columns and whether the pair is the head of its class.
    (``chunk``, ``at``) is the corpus position of column 0 of each context.
    """
    n = len(lo)
    size = hi - lo + length  # bytes of the context that belong to its windows
    begin = np.cumsum(size + 1) - size - 1
    total = int((size + 1).sum())
    record = np.repeat(np.arange(n), size + 1)
    col = np.arange(total) - begin[record] + lo[record]
    inside = col < hi[record] + length
    text = np.where(inside, ctx[record, np.minimum(col, ctx.shape[1] - 1)].astype(np.int32), 256)
    sa, _ = suffix_ranks(text, length)
    lcp = common_prefixes(text, sa, length)
    window = col <= hi[record]
    classes = np.cumsum(lcp < length)
    use = np.flatnonzero(window[sa])
    s, c = sa[use], classes[use]
    order = np.lexsort((at[record[s]] + col[s], chunk[record[s]], c))
    s, c = s[order], c[order]
    head = np.r_[True, c[1:] != c[:-1]] if len(c) else np.zeros(0, bool)
    return record[s], col[s], head


def lay_out(docs: DataFrame, id_col: str, text: str, chunk_bytes: int) -> DataFrame:
    """Chunks of texts in id order: chunk, ids, sizes in bytes, blob (zstd)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, ids, held, size, kind = TaskContext.get().partitionId() << 32, [], [], 0, pa.int64()

        def row() -> pa.RecordBatch:
            raw = b"".join(held)
            packed = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
            return pa.record_batch([pa.array([chunk], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([[len(x) for x in held]], pa.list_(pa.int64())), pa.array([packed], pa.binary())], names=["chunk", "ids", "sizes", "blob"])

        for batch in batches:
            kind = batch.column(0).type
            for key, t in zip(batch.column(0), batch.column(1).cast(pa.large_binary()), strict=True):
                raw = t.as_py() or b""
                ids.append(key.as_py())
                held.append(raw)
                size += len(raw)
                if size >= chunk_bytes or len(ids) >= 100_000:
                    yield row()
                    chunk, ids, held, size = chunk + 1, [], [], 0
        if ids:
            yield row()

    kind = docs.schema[id_col].dataType.simpleString()
    n = parts_for(docs, 32 << 20)
    dealt = docs.select(F.col(id_col), F.col(text), F.xxhash64(F.col(text)).alias("_h")).repartitionByRange(n, id_col).sortWithinPartitions(id_col, "_h")
    return store(dealt.select(id_col, text).mapInArrow(run, f"chunk bigint, ids array<{kind}>, sizes array<bigint>, blob binary"), "chunks")


def _open(sizes: list[int], blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(np.array(sizes, np.int64))
    total = int(ends[-1]) if len(ends) else 0
    return np.frombuffer(pa.decompress(blob, decompressed_size=total, codec="zstd", asbytes=True) if total else b"", np.uint8), ends


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(name)[k].as_py() for name in batch.schema.names}


def _with_sent(chunks: DataFrame, sent: DataFrame, n: int) -> DataFrame:
    """Chunks below the rows that were sent to their groups (``grp``), in ``n`` partitions."""
    placed = chunks.withColumn("grp", F.shiftright("chunk", GROUP))
    return placed.unionByName(sent, allowMissingColumns=True).repartition(n, "grp").sortWithinPartitions("grp", F.col("chunk").asc_nulls_first())


def _chunks_with(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[dict, list[tuple]]]:
    """The chunks of :func:`_with_sent`, each with the list (one for a group) of what its group was sent."""
    group, held = None, []
    for row in _rows(batches):
        if row["grp"] != group:
            group, held = row["grp"], []
        if row["chunk"] is None:
            held.append(tuple(row[x] for x in names))
        else:
            yield row, held


def _joined(parts: list[bytes], kind: np.dtype | str) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


def merge_sorted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two lists of heads sorted by distinct ``w`` -> one such list, and the later heads of those in both."""
    if not len(a) or not len(b):
        return (a if len(a) else b), a[:0]
    at = np.searchsorted(a["w"], b["w"])
    same = (at < len(a)) & (a["w"][np.minimum(at, len(a) - 1)] == b["w"])
    old, given = a[at[same]], b[same]
    first = (given["chunk"] < old["chunk"]) | (given["chunk"] == old["chunk"]) & (given["at"] < old["at"])
    merged = a.copy()
    merged[at[same]] = np.where(first, given, old)
    return np.insert(merged, at[~same], b[~same]), np.where(first, old, given)


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Runs of rows of one key of a table sorted by it."""
    held: list[dict] = []
    for row in _rows(batches):
        if held and held[0][key] != row[key]:
            yield held[0][key], held
            held = []
        held.append(row)
    if held:
        yield held[0][key], held


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 100, chunk_bytes: int = 2 << 20, hot: int = 5_000) -> tuple[DataFrame, DataFrame]:
    """(chunks, removals): removals are rows (group of chunks, packed stretches of removed bytes)."""
    side, w = length - GRAM, 2 * length - GRAM  # columns before the anchor, columns of a context
    chunks = lay_out(docs, id_col, text, chunk_bytes)
    total = chunks.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
    spark = docs.sparkSession
    free_shuffles(spark)
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // (32 << 20)) + 1)

    def send_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(group: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            h, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([x[1] for x in held]), minlength=len(h)).astype(np.int64)
            bucket = (h % np.uint64(n_parts)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            h, n, bucket = h[order], np.minimum(n[order], 2**32 - 1).astype("<u4"), bucket[order]
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(h) else np.zeros(0, np.int64)
            ends = np.r_[cut[1:], len(h)] if len(h) else cut
            return pa.record_batch(
                [pa.array(bucket[cut]), pa.array(np.full(len(cut), group, np.int64)), pa.array([h[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()), pa.array([n[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())],
                names=["bucket", "grp", "h", "n"],
            )

        group, held = None, []
        for row in _rows(batches):
            if held and group != row["chunk"] >> GROUP:
                yield rows(group, held)
                held = []
            group = row["chunk"] >> GROUP
            held.append(np.unique(anchors(*_open(row["sizes"], row["blob"]), length)[3], return_counts=True))
        if held:
            yield rows(group, held)

    def keep_repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "bucket"):
            h = _joined([r["h"] for r in rows], "<u8")
            n = _joined([r["n"] for r in rows], "<u4").astype(np.int64)
            values, back = np.unique(h, return_inverse=True)
            sums = np.bincount(back, weights=n)[back].astype(np.int64)
            at = 0
            out = []
            for r in rows:
                k = len(r["n"]) // 4
                use = sums[at : at + k] > 1
                if use.any():
                    out.append((r["grp"], h[at : at + k][use].tobytes(), np.minimum(sums[at : at + k][use], 2**32 - 1).astype("<u4").tobytes()))
                at += k
            yield pa.record_batch([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], names=["grp", "h", "n"])

    sent = chunks.mapInArrow(send_hashes, "bucket bigint, grp bigint, h binary, n binary")
    back = store(fewer_files(sent.repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(keep_repeated, "grp bigint, h binary, n binary"), n_parts), "repeated")

    meta_kind = np.dtype([("h", "<u8"), ("chunk", "<i8"), ("at", "<i4"), ("salts", "<i4")])

    def by_group(chunk: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[tuple[int, bytes]]:
        """Stretches -> (group, packed places of chunks in it and offsets)."""
        order = np.argsort(chunk, kind="stable")
        chunk, packed = chunk[order], np.stack([chunk & ((1 << GROUP) - 1), start, stop], axis=1)[order].astype("<i4")
        group = chunk >> GROUP
        cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
        return [(int(group[x]), packed[x:y].tobytes()) for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(group)][: len(cut)], strict=True)]

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(held: list[tuple]) -> pa.RecordBatch:
            """What the chunks of ``held`` found: equal contexts of a chunk (shard -1) and the others by shard."""
            own, gone_chunk, start, stop, shard, meta = (np.concatenate(x) if k else x for k, x in enumerate(zip(*held, strict=True)))
            spans = by_group(gone_chunk, start, stop)
            order = np.argsort(shard, kind="stable")
            shard, meta, own = shard[order], meta[order], np.concatenate(own)
            cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, np.int64)
            pieces = list(zip(cut.tolist(), [*cut[1:].tolist(), len(shard)][: len(cut)], strict=True))
            return pa.record_batch(
                [
                    pa.array([-1] * len(spans) + shard[cut].tolist(), pa.int64()), pa.array([x[0] for x in spans] + [None] * len(pieces), pa.int64()), pa.array([x[1] for x in spans] + [b""] * len(pieces), pa.binary()),
                    pa.array([b""] * len(spans) + [meta[x:y].tobytes() for x, y in pieces], pa.binary()), pa.array([b""] * len(spans) + [pa.compress(own[order[x:y]].tobytes(), codec="zstd", asbytes=True) for x, y in pieces], pa.binary()),
                ],
                names=["shard", "grp", "spans", "meta", "ctx"],
            )

        group, held, waiting = None, [], 0
        for row, given in _chunks_with(batches, ["h", "n"]):
            if group != row["grp"] or waiting >= 1 << 18:
                if held:
                    yield rows_of(held)
                held, waiting = [], 0
            if group != row["grp"]:
                group = row["grp"]
                h, n = _joined([x[0] for x in given], "<u8"), _joined([x[1] for x in given], "<u4")
                order = np.argsort(h)
                h, n = h[order], n[order]
            if not len(h):
                continue
            data, ends = _open(row["sizes"], row["blob"])
            a, lo, hi, key = anchors(data, ends, length)
            at = np.minimum(np.searchsorted(h, key), len(h) - 1)
            use = h[at] == key
            a, lo, hi, key, count = a[use], lo[use], hi[use], key[use], n[at[use]]
            view = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(side, np.uint8), data, np.zeros(w, np.uint8)]), w)
            reps: list[np.ndarray] = []
            gone = np.zeros(len(a), bool)
            kept, kept_at = np.zeros((0, w + 2), np.uint8), np.zeros(0, np.int64)
            for b in range(0, len(a), 1 << 16):
                i = np.arange(b, min(b + (1 << 16), len(a)))
                rel_lo, rel_hi = lo[i] - a[i] + side, hi[i] - a[i] + side
                rows = np.empty((len(i), w + 2), np.uint8)
                rows[:, :w] = view[a[i]]
                cols = np.arange(w)
                rows[:, :w][(cols < rel_lo[:, None]) | (cols >= rel_hi[:, None] + length)] = 0
                rows[:, w], rows[:, w + 1] = rel_lo, rel_hi
                both, both_at = np.concatenate([kept, rows]), np.concatenate([kept_at, i])
                _, own = row_groups(both)
                gone[both_at[~own]] = True
                kept, kept_at = both[own], both_at[own]
            i = kept_at
            salts = -(-count[i].astype(np.int64) // hot)
            own = row["chunk"] + (row["chunk"] >> 32)  # partition and number in it
            shard = ((key[i] * _MIX[1]) >> np.uint64(20)).astype(np.int64) + np.where(salts > 1, own % np.maximum(salts, 1), 0)
            shard %= n_parts
            meta = np.zeros(len(i), meta_kind)
            meta["h"], meta["chunk"], meta["at"], meta["salts"] = key[i], row["chunk"], a[i] - side, salts
            held.append((kept, np.full(int(gone.sum()), row["chunk"], np.int64), lo[gone], hi[gone] + length, shard, meta))
            waiting += len(i)
        if held:
            yield rows_of(held)

    opened = _with_sent(chunks.select("chunk", "sizes", "blob"), back, n_parts).mapInArrow(contexts, "shard bigint, grp bigint, spans binary, meta binary, ctx binary")
    routed = store(fewer_files(opened, n_parts), "contexts")
    drop(back)
    del opened
    free_shuffles(spark)

    def out_rows(spans: list[tuple[int, bytes]], heads: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array([s[0] for s in spans] + [-1] * len(heads), pa.int64()), pa.array([s[1] for s in spans] + [b""] * len(heads), pa.binary()), pa.array([-1] * len(spans) + [x[0] for x in heads], pa.int64()), pa.array([b""] * len(spans) + [x[1] for x in heads], pa.binary())],
            names=["grp", "spans", "bucket", "heads"],
        )

    head_kind = [("w", f"S{length}"), ("chunk", "<i8"), ("at", "<i4")]

    def sort_part(meta: np.ndarray, rows: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """The suffix array of the contexts of some whole anchors: stretches that go, and the class heads to be merged."""
        lo, hi = rows[:, w].astype(np.int64), rows[:, w + 1].astype(np.int64)
        record, col, head = shard_classes(lo, hi, rows, meta["chunk"], meta["at"].astype(np.int64), length)
        chunk, at = meta["chunk"][record], meta["at"][record] + col
        merge = head & (meta["salts"][record] > 1)
        items = np.zeros(int(merge.sum()), head_kind)
        if merge.any():
            view = np.lib.stride_tricks.sliding_window_view(rows[:, :w], length, axis=1)
            items["w"] = np.ascontiguousarray(view[record[merge], col[merge]]).view(f"S{length}")[:, 0]
            items["chunk"], items["at"] = chunk[merge], at[merge]
        return runs_of(chunk[~head], at[~head], length), items

    def dealt_heads(items: np.ndarray) -> list[tuple[int, bytes]]:
        """Heads by bucket, sorted in it."""
        if not len(items):
            return []
        raw = np.ascontiguousarray(items["w"]).view(np.uint8).reshape(len(items), length)
        bucket = (gram_hashes(np.ascontiguousarray(raw[:, :GRAM]).reshape(-1))[::GRAM] ^ gram_hashes(np.ascontiguousarray(raw[:, -GRAM:]).reshape(-1))[::GRAM]) % np.uint64(n_parts)
        order = np.argsort(items["w"], kind="stable")
        order = order[np.argsort(bucket[order], kind="stable")]
        items, bucket = items[order], bucket[order]
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        return [(int(bucket[x]), items[x:y].tobytes()) for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(items)], strict=True)]

    def sort_out(lost: list[tuple], heads: list[np.ndarray]) -> pa.RecordBatch:
        return out_rows(by_group(*(np.concatenate(x) for x in zip(*lost, strict=True))) if lost else [], dealt_heads(np.concatenate(heads)) if heads else [])

    def sort_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _grouped(batches, "shard"):
            meta = np.concatenate([np.frombuffer(r["meta"], meta_kind) for r in found])
            rows = np.empty((len(meta), w + 2), np.uint8)
            at = 0
            for r in found:
                n = len(r["meta"]) // meta.itemsize
                rows[at : at + n] = np.frombuffer(pa.decompress(r.pop("ctx"), decompressed_size=n * (w + 2), codec="zstd", asbytes=True), np.uint8).reshape(n, w + 2)
                at += n
            del found
            order = np.lexsort((meta["at"], meta["chunk"]))
            meta, rows = meta[order], rows[order]
            _, own = row_groups(rows)
            lost = ~own
            gone, heads = [(meta["chunk"][lost], meta["at"][lost] + rows[lost, w], meta["at"][lost] + rows[lost, w + 1] + length)], []
            meta, rows = meta[own], rows[own]
            # equal windows elect anchors at equal distances, so those of one context, which share one, all differ
            order = np.argsort(meta["h"], kind="stable")
            meta, rows = meta[order], rows[order]
            cut = np.flatnonzero(np.r_[True, meta["h"][1:] != meta["h"][:-1]])
            size = np.diff(np.r_[cut, len(meta)])
            several = np.repeat((size > 1) | (meta["salts"][cut] > 1), size)
            meta, rows = meta[several], rows[several]
            begin = 0
            while begin < len(meta):
                stop = min(begin + 12_000, len(meta))
                if stop < len(meta):
                    stop = int(np.searchsorted(meta["h"], meta["h"][stop - 1], "right"))
                found_gone, found_heads = sort_part(meta[begin:stop], rows[begin:stop])
                gone.append(found_gone)
                heads.append(found_heads)
                begin = stop
                if sum(map(len, heads)) >= 1 << 18 or sum(len(x[0]) for x in gone) >= 1 << 20:
                    yield sort_out(gone, heads)
                    gone, heads = [], []
            yield sort_out(gone, heads)

    def merge_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _grouped(batches, "bucket"):
            lists, losers = [np.frombuffer(r.pop("heads"), head_kind) for r in found], [np.zeros(0, head_kind)]
            while len(lists) > 1:
                pairs = [merge_sorted(a, b) for a, b in zip(lists[::2], lists[1::2], strict=False)]
                losers += [x[1] for x in pairs]
                lists = [x[0] for x in pairs] + lists[2 * len(pairs) :]
            gone = np.concatenate(losers)
            yield out_rows(by_group(*runs_of(gone["chunk"], gone["at"].astype(np.int64), length)), [])

    schema = "grp bigint, spans binary, bucket bigint, heads binary"
    shards = routed.filter("shard >= 0").select("shard", "meta", "ctx")
    sorted_ = store(fewer_files(shards.repartition(n_parts, "shard").sortWithinPartitions("shard").mapInArrow(sort_shard, schema), n_parts), "sorted")
    free_shuffles(spark)
    removals = routed.filter("shard < 0").select("grp", "spans").unionByName(sorted_.filter("grp >= 0").select("grp", "spans"))
    heads = sorted_.filter("bucket >= 0").select("bucket", "heads")
    merged = heads.repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(merge_heads, schema)
    return chunks, removals.unionByName(merged.filter("grp >= 0").select("grp", "spans"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 100, keep_text: bool = False, **options) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256, spans [start, stop) of removed bytes and, if asked for, the kept bytes."""
    chunks, removals = repeated_spans(docs, id_col, text, length, **options)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None
        for row, removed in _chunks_with(batches, ["spans"]):
            if group != row["grp"]:
                group, spans = row["grp"], _joined([x[0] for x in removed], "<i4").reshape(-1, 3)
            data, ends = _open(row["sizes"], row["blob"])
            step = np.zeros(len(data) + 1, np.int32)
            of_chunk = spans[spans[:, 0] == row["chunk"] & ((1 << GROUP) - 1)]
            np.add.at(step, of_chunk[:, 1], 1)
            np.add.at(step, of_chunk[:, 2], -1)
            gone = np.cumsum(step[:-1]) > 0
            out = []
            a = 0
            for key, b in zip(row["ids"], ends.tolist(), strict=True):
                g = gone[a:b]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]]))).tolist()
                kept = data[a:b][~g].tobytes()
                out.append({"id": key, "n_bytes": b - a, "n_removed": int(g.sum()), "n_spans": len(edge) // 2, "kept_sha256": hashlib.sha256(kept).hexdigest(), "spans": [{"start": p, "stop": q} for p, q in zip(edge[::2], edge[1::2], strict=True)]} | ({"kept": kept} if keep_text else {}))
                a = b
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    kind = chunks.schema["ids"].dataType.elementType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = pa.schema([("id", to_arrow_type(kind)), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))] + [("kept", pa.binary())] * keep_text)
    n = parts_for(chunks, 32 << 20)
    return fewer_files(_with_sent(chunks, removals, n).mapInArrow(cut, f"id {kind.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,stop:bigint>>" + ", kept binary" * keep_text), n)
