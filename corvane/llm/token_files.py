"""Token-id files of directly addressable codes.

An id is cut into chunks of 8 bits, low chunk first. Level k holds the k-th chunks
of all ids that have one, a bitmap that says which of them continue, and a rank
directory (ones before each 512 bits), so that ``DirectCodes.get`` follows one id
through the levels without decoding its neighbours (Brisaboa, Ladra, Navarro,
"DACs: Bringing Direct Access to Variable-Length Codes").

A file is a Parquet table of segments, written by Spark's committer: a lost
executor's tasks run again and leave no half-written file. A segment holds whole
documents in ascending id order: their ids, numbers of tokens and the levels.
``shard`` and ``number`` order the segments; ``start`` counts tokens in the shard.

Defined results: a null text is encoded as the empty one and has the end id only;
rows of equal id lie in the order of their texts, the shorter hash first; a null
id comes first; an empty table gives files without segments.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.encoding import blocks, encoder, forget
from corvane.llm.scratch import new_path
from corvane.llm.tables import fewer_files, parts_for

STEP = 512


class DirectCodes:
    """Random access to a sequence of unsigned 32-bit ids."""

    def __init__(self, n: int, chunks: list[np.ndarray], bitmaps: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.chunks, self.bitmaps, self.ranks = n, chunks, bitmaps, ranks

    @classmethod
    def pack(cls, ids: np.ndarray) -> DirectCodes:
        rest, chunks, bitmaps, ranks = np.asarray(ids, np.uint32), [], [], []
        while len(rest) or not chunks:
            chunks.append((rest & 255).astype(np.uint8))
            rest = rest >> np.uint32(8)
            go_on = rest > 0
            bitmaps.append(np.packbits(go_on, bitorder="little"))
            pad = np.zeros(-(-max(len(go_on), 1) // STEP) * STEP, np.int64)
            pad[: len(go_on)] = go_on
            ranks.append(np.concatenate([[0], np.cumsum(pad.reshape(-1, STEP).sum(axis=1))[:-1]]).astype("<u4"))
            rest = rest[go_on]
        return cls(len(ids), chunks, bitmaps, ranks)

    def get(self, at: int) -> int:
        """The id at one place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level, (chunk, bits, rank) in enumerate(zip(self.chunks, self.bitmaps, self.ranks, strict=True)):
            value |= int(chunk[at]) << (8 * level)
            if not bits[at >> 3] >> (at & 7) & 1:
                break
            first = at // STEP * STEP
            before = np.unpackbits(bits[first >> 3 : (at >> 3) + 1], bitorder="little")[: at - first].sum()
            at = int(rank[at // STEP]) + int(before)
        return value

    def unpack(self) -> np.ndarray:
        out, place = np.zeros(self.n, np.uint32), np.arange(self.n)
        for level, (chunk, bits) in enumerate(zip(self.chunks, self.bitmaps, strict=True)):
            out[place] |= chunk.astype(np.uint32) << np.uint32(8 * level)
            place = place[np.unpackbits(bits, count=len(chunk), bitorder="little").astype(bool)]
        return out

    def to_row(self) -> dict:
        return {"n": self.n, "chunks": [c.tobytes() for c in self.chunks], "bitmaps": [b.tobytes() for b in self.bitmaps], "ranks": [r.tobytes() for r in self.ranks]}

    @classmethod
    def from_row(cls, row: dict) -> DirectCodes:
        return cls(row["n"], *([np.frombuffer(x, t) for x in row[k]] for k, t in (("chunks", np.uint8), ("bitmaps", np.uint8), ("ranks", "<u4"))))


def write_tokens(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text: str = "text", end_id: int = 2, segment_tokens: int = 1 << 19) -> str:
    """Encode every whole text, append ``end_id``, and write the files in ascending id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard, number, start = encoder(vocabulary), TaskContext.get().partitionId(), 0, 0
        ids, counts, held, size = [], [], [], 0
        schema = None

        def segment() -> pa.RecordBatch:
            flat = np.concatenate(held)
            row = {"shard": shard, "number": number, "start": start, "ids": ids, "counts": counts} | DirectCodes.pack(flat).to_row()
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            if schema is None:
                schema = pa.schema([("shard", pa.int32()), ("number", pa.int32()), ("start", pa.int64()), ("ids", pa.list_(batch.column(0).type)), ("counts", pa.list_(pa.int64())), ("n", pa.int64()), ("chunks", pa.list_(pa.binary())), ("bitmaps", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))])
            keys = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts):
                for key, found in zip(keys[a:b], enc.encode(texts[a:b]), strict=True):
                    ids.append(key)
                    counts.append(len(found) + 1)
                    held.append(np.append(found, np.uint32(end_id)))
                    size += len(found) + 1
                    if size >= segment_tokens:
                        yield segment()
                        start, number = start + size, number + 1
                        ids, counts, held, size = [], [], [], 0
        if ids:
            yield segment()

    n = parts_for(docs, 32 << 20)
    kind = docs.schema[id_col].dataType.simpleString()
    dealt = docs.select(F.col(id_col), F.col(text), F.xxhash64(F.col(text)).alias("_h")).repartitionByRange(n, id_col).sortWithinPartitions(id_col, "_h", text)
    rows = dealt.select(id_col, text).mapInArrow(run, f"shard int, number int, start bigint, ids array<{kind}>, counts array<bigint>, n bigint, chunks array<binary>, bitmaps array<binary>, ranks array<binary>")
    rows.write.parquet(path)
    return path


def read_files(spark, path: str) -> DataFrame:
    """The segments, with ``base``: the tokens of all shards before theirs."""
    segments = spark.read.parquet(path)
    totals = segments.groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect()  # a row for each written partition
    bases, at = [], 0
    for r in totals:
        bases.append((r.shard, at))
        at += r.n
    joined = segments.join(F.broadcast(spark.createDataFrame(bases, "shard int, base bigint")), "shard")
    return fewer_files(joined, len(bases)) if bases else joined


def read_documents(spark, path: str, with_tokens: bool = False) -> DataFrame:
    """Per document in the files: id, start, n_tokens, ids_crc32 and, if asked for, its tokens."""
    segments = read_files(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # all texts have been encoded
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                row = {name: one.column(name)[0].as_py() for name in ("base", "start", "counts", "n", "chunks", "bitmaps", "ranks")}
                flat = DirectCodes.from_row(row).unpack().astype("<u4")
                counts = np.array(row["counts"], np.int64)
                ends = np.cumsum(counts)
                parts = [flat[e - c : e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                columns = [one.column("ids")[0].values, pa.array(row["base"] + row["start"] + ends - counts), pa.array(counts), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                names = ["id", "start", "n_tokens", "ids_crc32"]
                if with_tokens:
                    columns.append(pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
                    names.append("tokens")
                yield pa.record_batch(columns, names=names)

    kind = segments.schema["ids"].dataType.elementType.simpleString()
    cols = ["base", "start", "ids", "counts", "n", "chunks", "bitmaps", "ranks"]
    return segments.select(*cols).mapInArrow(run, f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", tokens array<bigint>" * with_tokens)


def token_at(spark, path: str, place: int) -> int:
    """One token of the whole sequence: reads the row of its segment, decodes nothing else."""
    hit = read_files(spark, path).filter((F.col("base") + F.col("start") <= place) & (F.col("base") + F.col("start") + F.col("n") > place)).select("base", "start", "n", "chunks", "bitmaps", "ranks").first()
    if hit is None:
        raise IndexError(place)
    row = hit.asDict()
    return DirectCodes.from_row(row).get(place - row["base"] - row["start"])


def token_digest(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write token files for ``docs`` to the shared folder and report what they hold."""
    spark = docs.sparkSession
    return read_documents(spark, write_tokens(docs, new_path(spark, "tokens"), vocabulary, id_col, text))
