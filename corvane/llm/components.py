"""Connected components of an edge table by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond". Labels, links and
components stay in tables; only a row count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.scratch import drop, store
from corvane.llm.tables import fewer_files


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def stars(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of one ordered type -> rows (a, b): b is the least node that a reaches, b < a.

    Nodes that are the least of their component have no row. Null ends and loops
    are ignored. The number of rounds grows with the logarithm of a component's
    diameter; each round is written, so a lost executor costs one round at most.
    """
    now = store(fewer_files(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), "edges")
    before = _state(now)
    while before[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # a table of its own, so that both sides of the join are plain exchanges and a hub's edges can be split
        least = store(fewer_files(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        following = store(fewer_files(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()), "edges")
        drop(now, least)
        now, after = following, _state(following)
        if after == before:
            break
        before = after
    return now
