"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target share r = target / size gets floor(r) copies
for sure; the fraction is rounded pivotally. Two undecided documents of a source
trade mass, in words so that the source's expected words stay what they are,
until one of them is at 0 or 1; the other goes on. Each bucket of documents ends
with at most one undecided document a source; these residuals meet in a reduction
tree of fixed fan-in, and the last one of a source is rounded by its probability.
A source's taken words thus differ from its target by less than one document.

Documents are dealt into buckets by hash, not by source, so a source with a third
of all rows is spread like any other; only (id, size, source) is shuffled. The
order within a bucket and all random numbers derive from the rows and the seed, so
reruns agree on any cluster.

Defined results: a null text has size 0 and takes 0; a null source is a source of
its own, last in order; repeated rows are rounded each on its own; an empty table
gives an empty table; if no text has words all targets are 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.scratch import drop, store
from corvane.llm.tables import fewer_files, row_key, whole_rows

SCHEMA = "id {kind}, size bigint, source string, bucket bigint, copies bigint, part double"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> dict[str | None, float]:
    """Words to take of each source: shares by weight, none above ``most`` times its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(names)}
    out, open_, rest = {}, list(names), float(sum(sizes.values()))
    while open_:
        whole = sum(weight[s] for s in open_)
        full = [s for s in open_ if rest * weight[s] / whole > most * sizes[s]]
        if not full:
            return out | {s: rest * weight[s] / whole for s in open_}
        for s in full:
            out[s] = most * sizes[s]
        rest -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def _uniform(seed: int, *key) -> float:
    from xxhash import xxh64_intdigest

    return (xxh64_intdigest(repr(key), seed) >> 11) / (1 << 53)


def settle(rows: list[dict], seed: int, level: int, final: bool = False) -> list[dict]:
    """Decide all but at most one of the undecided ``rows`` of one source; with ``final`` all of them.

    ``part`` is the fraction still to be rounded; a decided row has none, and its
    ``copies`` are complete. A trade keeps size * part summed over the pair.
    """
    held = None
    for row in rows:
        if held is None:
            held = row
            continue
        a, b = held, row
        sa, sb = a["size"], b["size"]
        up = min((1 - a["part"]) * sa, b["part"] * sb)
        down = min(a["part"] * sa, (1 - b["part"]) * sb)
        # mass goes to a with probability down / (up + down): the expected parts stay
        if _uniform(seed, level, a["id"], b["id"], a["bucket"], b["bucket"]) * (up + down) < down:
            move = up
            a_full = (1 - a["part"]) * sa <= b["part"] * sb
            pa_, pb_ = (1.0, b["part"] - move / sb) if a_full else (a["part"] + move / sa, 0.0)
        else:
            move = down
            a_empty = a["part"] * sa <= (1 - b["part"]) * sb
            pa_, pb_ = (0.0, b["part"] + move / sb) if a_empty else (a["part"] - move / sa, 1.0)
        a["part"], b["part"] = min(max(pa_, 0.0), 1.0), min(max(pb_, 0.0), 1.0)
        held = None
        for x in (a, b):
            if x["part"] <= 1e-12 or x["part"] >= 1 - 1e-12:
                x["copies"] += round(x["part"])
                x["part"] = None
            else:
                held = x
    if held is not None and final:
        held["copies"] += int(_uniform(seed, "last", held["id"], held["bucket"]) < held["part"])
        held["part"] = None
    return rows


def _emit(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def fold(rows: DataFrame, seed: int, level: int, final: bool) -> DataFrame:
    """Settle runs of equal (bucket, source) of a table dealt and sorted by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        key = schema = None
        for batch in batches:
            schema = schema or batch.schema
            ready = []
            for row in batch.to_pylist():
                if (row["bucket"], row["source"]) != key or len(held) >= 4096:
                    if held and (row["bucket"], row["source"]) == key:
                        settle(held, seed, level)
                        ready += [r for r in held if r["part"] is None]
                        held = [r for r in held if r["part"] is not None]
                    else:
                        ready += settle(held, seed, level, final)
                        held = []
                    key = (row["bucket"], row["source"])
                held.append(row)
            if ready:
                yield _emit(ready, schema)
        if held:
            yield _emit(settle(held, seed, level, final), schema)

    return rows.mapInArrow(run, rows.schema)


def target_table(sums: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """:func:`targets` for sources too many for the driver: rows (source, size) -> (s, source_size, target, share).

    Sources are numbered in order by their place in a range partition and the counts
    before it; each round of resharing is one pass over the table.
    """
    order = [F.col("source").isNull(), F.col("source")]
    placed = store(sums.select("source", "size").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    before, n = {}, 0
    for r in placed.groupBy(part.cast("int").alias("part")).count().orderBy("part").collect():  # a row for each partition
        before[r.part], n = n, n + r["count"]
    starts = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    number = F.element_at(starts, part.cast("int")) + F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    rows = store(placed.select("source", "size", weight.alias("w"), (F.col("size") / weight).alias("level")), "weights")
    total, bound = float(rows.agg(F.sum("size")).first()[0] or 0), -1.0
    while True:  # sources up to a size for their weight are full
        full = F.col("level") <= bound
        r = rows.agg(F.sum(F.when(full, most * F.col("size"))).alias("full"), F.sum(F.when(~full, F.col("w"))).alias("open")).first()
        rest, whole = total - (r.full or 0.0), r.open or 0.0
        following = rest / whole / most if whole else bound
        more = rows.filter(~full & (F.col("level") < following)).agg(F.max("level")).first()[0] if whole else None
        if more is None:
            break
        bound = more
    goal = F.when(full, most * F.col("size")).otherwise(F.lit(rest / whole if whole else 0.0) * F.col("w"))
    drop(placed)
    return rows.select(F.col("source").alias("s"), F.col("size").alias("source_size"), goal.alias("target"), F.when(F.col("size") > 0, goal / F.col("size")).otherwise(0.0).alias("share"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 20, bucket_rows: int = 4096, fan_in: int = 16, driver_sources: int = 100_000) -> DataFrame:
    """Per row of ``docs``: id, size, source, source_size, target and copies (how often the mix takes it).

    The targets of up to ``driver_sources`` sources are reckoned by the driver and
    broadcast; those of more stay in a table (:func:`target_table`).
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    sized = store(docs.select(F.col(id_col).alias("id"), word_count(F.col(text)).alias("size"), F.col(source).cast("string").alias("source"), F.xxhash64(F.col(text)).alias("h")), "sizes")
    grouped = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    sums = grouped.limit(driver_sources + 1).collect()
    if len(sums) > driver_sources:
        n_rows, share = sized.count(), target_table(grouped, weights, most)
    else:
        n_rows, size_of = sum(r.n for r in sums), {r.source: r.size for r in sums}
        goal = targets(size_of, weights, most)
        shares = [(s, size_of[s], goal[s], goal[s] / size_of[s] if size_of[s] else 0.0) for s in size_of]
        share = F.broadcast(spark.createDataFrame(shares or [(None, 0, 0.0, 0.0)], "s string, source_size bigint, target double, share double"))
    with_share = sized.join(share, sized["source"].eqNullSafe(share["s"])).drop("s")

    buckets = max(1, math.ceil(n_rows / bucket_rows))
    whole = F.when(F.col("size") > 0, F.floor("share")).otherwise(F.lit(0)).cast("long")
    part = F.when((F.col("size") > 0) & (F.col("share") > F.floor("share")), F.col("share") - F.floor("share"))
    start = with_share.select("id", "size", "source", F.pmod(F.xxhash64("id", "h"), F.lit(buckets)).cast("long").alias("bucket"), whole.alias("copies"), part.alias("part"), "h")
    sure = start.filter("part is null").drop("h")
    ordered = start.filter("part is not null").repartition("bucket").sortWithinPartitions("bucket", "source", F.desc("size"), F.xxhash64("id", F.lit(seed)), "id", "h").drop("h")
    state = store(fewer_files(fold(ordered, seed, 0, buckets == 1)), "mix")
    done, level = [sure, state.filter("part is null")], 1
    while buckets > 1:
        buckets = math.ceil(buckets / fan_in)
        left = state.filter("part is not null").withColumn("up", F.floor(F.col("bucket") / fan_in).cast("long"))
        tree = left.repartition("up", "source").sortWithinPartitions("up", "source", F.desc("size"), "bucket").select("id", "size", "source", F.col("up").alias("bucket"), "copies", "part")
        state = store(fewer_files(fold(tree, seed, level, buckets == 1)), "mix")
        done.append(state.filter("part is null"))
        level += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    out = out.select("id", "size", "source", "copies")
    return out.join(share, out["source"].eqNullSafe(share["s"])).select(F.col("id").cast(kind).alias("id"), "size", "source", "source_size", "target", "copies")


def repeat_by_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it has copies.

    Rows of one id, text and source are told apart by nothing that the mix sees; their
    copies are dealt to them in turn, so that each stands for itself.
    """
    key = row_key(F.col(id_col), F.col(text), F.col(source)).alias("key")
    keyed = docs.select(key, F.col(text).alias("text"), F.col(source).alias("source"))
    counted = mix(keyed, "key", "text", "source", **options).groupBy("id").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("alike"))
    counts = store(fewer_files(counted.filter("copies > 0").select(F.col("id").alias("key"), "copies", "alike")), "copies")
    joined = whole_rows(docs, key).join(counts.hint("merge"), "key")
    times = F.sequence(F.lit(1).cast("long"), F.col("times"))

    def repeated(rows: DataFrame) -> DataFrame:
        return rows.select("row", F.explode(times)).select("row.*")

    single = repeated(joined.filter("alike = 1").select("row", F.col("copies").alias("times")))
    if counts.filter("alike > 1").isEmpty():
        return single
    turn = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row")))  # rows repeated whole
    share = F.floor(F.col("copies") / F.col("alike")) + F.when(turn <= F.col("copies") % F.col("alike"), 1).otherwise(0)
    many = joined.filter("alike > 1").select("row", share.cast("long").alias("times")).filter("times > 0")
    return single.unionByName(repeated(many))
