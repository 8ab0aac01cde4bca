"""Lexical sidecar: exact, phrase and trigram matches over a record's fields.

A field equal to the query scores 1.0, one that holds it as a phrase 0.9, any other
the Jaccard of its trigrams if that reaches the threshold. A block of distinct queries
is an inverted index of trigrams in each task; a task counts the trigrams that a value
shares with all queries of the block once, and keeps its own best of each query.
Records are read once a block and only these best are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import lexical_form
from corvane.operators.retrieve import Best, query_blocks

FIELDS = ("title", "section_title", "section_path", "document_path", "text")


def trigram_set(value: str) -> set[str]:
    padded = f"  {value}  "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


class _Needles:
    """Distinct queries with an inverted index of their trigrams."""

    #: Matches that a task remembers by value.
    REMEMBERED = 1_000_000

    def __init__(self, needles: list[str], threshold: float) -> None:
        self.needles, self.threshold = needles, threshold
        index: dict[str, list[int]] = {}
        self.sizes = np.zeros(len(needles), np.int64)
        for n, needle in enumerate(needles):
            found = trigram_set(needle)
            self.sizes[n] = len(found)
            for t in found:
                index.setdefault(t, []).append(n)
        self.lists = {t: np.array(v, np.int64) for t, v in index.items()}
        self.seen: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.held = 0

    def matches(self, value: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(needle, score, is it exact) of all that match; a value that comes again is looked up."""
        if value in self.seen:
            return self.seen[value]
        own = trigram_set(value)
        held = [self.lists[t] for t in own if t in self.lists]
        out: list[tuple[int, float, bool]] = []
        if held:
            shared = np.bincount(np.concatenate(held), minlength=len(self.needles))
            near = np.round(shared / (self.sizes + len(own) - shared), 9)
            # a phrase or an equal field holds all of the query's trigrams but the four at its ends
            for n in np.flatnonzero((near >= self.threshold) | (shared >= np.maximum(self.sizes - 4, 1))).tolist():
                if value == self.needles[n]:
                    out.append((n, 1.0, True))
                elif f" {self.needles[n]} " in f" {value} ":
                    out.append((n, 0.9, True))
                elif near[n] >= self.threshold:
                    out.append((n, float(near[n]), False))
        n, score, exact = zip(*out, strict=True) if out else ((), (), ())
        found = np.array(n, np.int64), np.array(score, np.float64), np.array(exact, bool)
        if self.held > self.REMEMBERED:
            self.seen, self.held = {}, 0
        self.seen[value] = found
        self.held += len(out) + 10
        return found


def sidecar_topk(queries: DataFrame, records: DataFrame, k: int, fields: Sequence[str] = FIELDS, threshold: float = 0.35, block_queries: int = 20_000) -> DataFrame:
    """``queries``: qid, query; ``records``: id and ``fields`` -> qid, id, score, field, strategy, rank.

    Equal queries are answered once, equal fields matched once a task; each task sends
    the best ``k`` of a distinct query.
    """
    q = queries.select("qid", lexical_form(F.col("query")).alias("needle")).filter("needle <> ''")
    present = [f for f in fields if f in records.columns]
    r = records.select("id", *[lexical_form(F.col(f)).alias(f"v{n}") for n, f in enumerate(present)])
    schema = f"needle string, id {records.schema['id'].dataType.simpleString()}, place int, score double, exact boolean"
    found, blocks = None, 0
    for block in query_blocks(q.select("needle").distinct().orderBy("needle"), block_queries):
        needles = [x[0] for x in block]

        def run(batches: Iterator[pa.RecordBatch], needles=needles) -> Iterator[pa.RecordBatch]:
            index, best = _Needles(needles, threshold), Best(len(needles), k, once=True)
            for batch in batches:
                for place in range(len(present)):
                    values = batch.column(1 + place).dictionary_encode()
                    hits = [index.matches(v) if v else None for v in values.dictionary.to_pylist()]
                    code = values.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                    order = np.argsort(code, kind="stable")
                    bounds = np.searchsorted(code[order], np.arange(len(hits) + 1))
                    rows, number, score, exact = [], [], [], []
                    for c, hit in enumerate(hits):
                        if hit is None:
                            continue
                        can = np.flatnonzero(hit[1] >= best.floor[hit[0]])
                        own = order[bounds[c] : bounds[c + 1]]
                        rows.append(np.repeat(own, len(can)))
                        for into, x in ((number, hit[0]), (score, hit[1]), (exact, hit[2])):
                            into.append(np.tile(x[can], len(own)))
                    if rows:
                        at = np.concatenate(rows)
                        best.add(np.concatenate(number), np.concatenate(score), batch.column(0).take(pa.array(at)), place=pa.array(np.full(len(at), place, np.int32)), exact=pa.array(np.concatenate(exact)))
            for b in best.rows():
                yield pa.record_batch([pa.array([needles[n] for n in b["n"].to_pylist()], pa.string()), b["id"], b["place"], b["score"], b["exact"]], names=["needle", "id", "place", "score", "exact"])

        part = r.mapInArrow(run, schema)
        found, blocks = part if found is None else found.unionByName(part), blocks + 1
    if found is None:
        found = r.sparkSession.createDataFrame([], schema)
    best = found.groupBy("needle", "id").agg(F.max_by(F.struct("place", "exact"), F.struct("score", -F.col("place"))).alias("b"), F.max("score").alias("score"))
    order = Window.partitionBy("needle").orderBy(F.desc("score"), "id")
    top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    top = top.groupBy("needle").agg(F.collect_list(F.struct("id", "score", "b", "rank")).alias("t"))
    field = F.element_at(F.array(*[F.lit(f) for f in present]), F.col("t.b.place") + 1) if present else F.lit(None).cast("string")
    each = q.join(F.broadcast(top) if blocks == 1 else top, "needle").select("qid", F.explode("t").alias("t"))
    return each.select("qid", "t.id", "t.score", field.alias("field"), F.when(F.col("t.b.exact"), "exact").otherwise("trigram").alias("strategy"), "t.rank")


def bounded_records(records: DataFrame, order: str, text_bytes: str, max_entries: int = 100_000, max_bytes: int = 256 << 20, scope: str = "collection") -> DataFrame:
    """Records of a scope up to a number and a size, in order; what is beyond is refused."""
    w = Window.partitionBy(scope).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("_n", F.row_number().over(Window.partitionBy(scope).orderBy(order))).withColumn("_b", F.sum(text_bytes).over(w)).filter((F.col("_n") <= max_entries) & (F.col("_b") <= max_bytes)).drop("_n", "_b")
