"""Rank fusion, diversity, boosts, reranking and merges over (qid, id, score, rank) tables.

Formulas that engines leave to their stores are fixed here:

* weighted RRF: the sum over channels of w / (k + rank);
* DBSF: a channel's scores are mapped linearly from mean -3 to +3 population standard
  deviations onto 0 to 1, clipped, and summed; a channel without spread gives 0.5;
* boosts add a decay of a numeric field to the score.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import safe_score
from corvane.operators.retrieve import ranked


def union_channels(channels: Sequence[DataFrame]) -> DataFrame:
    """Channels one below the other with their number, a document once a channel at its best rank."""
    out = None
    for n, c in enumerate(channels):
        part = c.select("qid", "id", F.col("score").cast("double").alias("score"), "rank").withColumn("channel", F.lit(n))
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("qid", "channel", "id").orderBy("rank")
    return out.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def rrf(channels: Sequence[DataFrame], limit: int, k: int = 60, weights: Sequence[float] | None = None, digits: int = 9) -> DataFrame:
    """Reciprocal rank fusion; ties by first channel, rank and id."""
    if weights is not None and len(weights) != len(channels):
        raise ValueError("one weight a channel")
    rows = union_channels(channels)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights or [1.0] * len(channels)]), F.col("channel") + 1)
    sums = rows.withColumn("share", w / (k + F.col("rank"))).groupBy("qid", "id").agg(
        F.round(F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("channel", "share"))), lambda x: x["share"]), F.lit(0.0), lambda a, x: a + x), digits).alias("score"),
        F.min(F.struct("channel", "rank", "id")).alias("_tie"),
    )
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "_tie")
    return sums.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("qid", "id", "score", "rank")


def dbsf(channels: Sequence[DataFrame], limit: int, digits: int = 6) -> DataFrame:
    """Distribution-based score fusion."""
    rows = union_channels(channels)
    w = Window.partitionBy("qid", "channel")
    mean, sd = F.avg("score").over(w), F.stddev_pop("score").over(w)
    unit = F.when(sd == 0, 0.5).otherwise(F.least(F.greatest((F.col("score") - mean + 3 * sd) / (6 * sd), F.lit(0.0)), F.lit(1.0)))
    return ranked(rows.withColumn("u", unit).groupBy("qid", "id").agg(F.sum("u").alias("score")), limit, digits)


def boost(hits: DataFrame, field: Column, kind: str, target: float, scale: float, midpoint: float = 0.5, digits: int = 6) -> DataFrame:
    """``score`` plus a decay of ``field``: 1 at ``target``, ``midpoint`` at ``scale`` from it; null fields add nothing."""
    d = F.abs(field.cast("double") - target)
    decays = {
        "linear": lambda: F.greatest(F.lit(0.0), 1 - (1 - midpoint) * d / scale),
        "exp": lambda: F.pow(F.lit(midpoint), d / scale),
        "gauss": lambda: F.pow(F.lit(midpoint), F.pow(d / scale, 2)),
    }
    if kind not in decays:
        raise ValueError(f"boost {kind!r}")
    rows = hits.withColumn("score", F.col("score") + F.coalesce(decays[kind](), F.lit(0.0))).drop("rank")
    return ranked(rows, 2**31 - 1, digits)


def nested(outer: DataFrame, shortlist: DataFrame, limit: int) -> DataFrame:
    """Rows of ``outer`` (qid, id, score) whose document is in the query's shortlist, ranked anew."""
    return ranked(outer.drop("rank").join(shortlist.select("qid", "id").distinct(), ["qid", "id"], "left_semi"), limit)


def mmr(candidates: DataFrame, diversity: float, limit: int, candidate_limit: int = 200) -> DataFrame:
    """Maximal marginal relevance over (qid, id, score, rank, vec): (1 - d) * score - d * highest cosine to what was chosen.

    At most ``candidate_limit`` candidates of a query take part, by rank: the bound
    is the operator's own parameter and keeps a query's group small.
    """
    if not 0 < diversity < 1:
        raise ValueError("diversity lies between 0 and 1")
    part = candidates.filter(F.col("rank") <= candidate_limit)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = rows.sort_values(["rank", "id"]).reset_index(drop=True)
        v = np.array(rows["vec"].tolist(), float)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
        score, far = rows["score"].to_numpy(float), np.zeros(len(rows))
        left, out = list(range(len(rows))), []
        while left and len(out) < limit:
            value = np.round((1 - diversity) * score[left] - diversity * far[left], 9)
            best = left.pop(int(value.argmax()))
            out.append((rows.at[best, "qid"], rows.at[best, "id"], float(value.max()), len(out) + 1))
            near = v @ v[best]
            far = np.maximum(far, near) if len(out) > 1 else near
        return pd.DataFrame(out, columns=["qid", "id", "score", "rank"])

    t = dict(candidates.dtypes)
    return part.select("qid", "id", "score", "rank", "vec").groupBy("qid").applyInPandas(choose, f"qid {t['qid']}, id {t['id']}, score double, rank int")


def valid_rerank_rows(rows: DataFrame, n_documents: Column) -> DataFrame:
    """Provider rows (qid, index, score, arrival): index in range, the first of each index, finite score; ranked by score."""
    ok = F.col("index").between(0, n_documents - 1) & F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    first = Window.partitionBy("qid", "index").orderBy("arrival")
    by_score = Window.partitionBy("qid").orderBy(F.desc("score"), "index")
    return rows.filter(ok).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").withColumn("rerank_rank", F.row_number().over(by_score))


def apply_rerank(hits: DataFrame, reranked: DataFrame, pool: int) -> DataFrame:
    """Hits in the provider's order: reranked ones first, then the rest of the pool, then the tail as it was.

    ``reranked``: qid, id, rerank_score, rerank_rank. A query without any (a failed
    provider) keeps its order. ``delta`` is how many places a hit has gained.
    """
    known = F.when(F.col("rank") <= pool, F.coalesce("rerank_rank", F.lit(2**31 - 1))).otherwise(F.lit(2**31 - 1))
    tail = (F.col("rank") > pool).cast("int")
    w = Window.partitionBy("qid").orderBy(tail, known, "rank")
    out = hits.join(reranked, ["qid", "id"], "left").withColumn("new_rank", F.row_number().over(w))
    return out.select("qid", "id", F.coalesce("rerank_score", "score").alias("score"), F.col("new_rank").alias("rank"), F.col("rank").alias("original_rank"), (F.col("rank") - F.col("new_rank")).alias("delta"))


def rerank_deltas(reranked: DataFrame) -> DataFrame:
    """Per query: how many hits moved, up and down, and the largest moves."""
    d = F.col("delta")
    return reranked.groupBy("qid").agg(
        F.count_if(d != 0).alias("changed"), F.count_if(d > 0).alias("promoted"), F.count_if(d < 0).alias("demoted"),
        F.greatest(F.max(d), F.lit(0)).alias("max_gain"), F.greatest(F.max(-d), F.lit(0)).alias("max_loss"),
    )


def admit_sidecar(side: DataFrame, vector: DataFrame, limit: int) -> DataFrame:
    """Lexical rows (qid, id, score, rank) that may join: those among the vector hits, and as many others as leave room, one at least."""
    n = vector.groupBy("qid").agg(F.count(F.lit(1)).alias("_have"))
    flagged = side.join(vector.select("qid", "id").distinct().withColumn("_in", F.lit(True)), ["qid", "id"], "left").join(n, "qid", "left")
    new = F.coalesce("_in", F.lit(False))
    w = Window.partitionBy("qid", new).orderBy("rank", "id")
    room = F.greatest(F.lit(limit) - F.coalesce("_have", F.lit(0)), F.lit(1))
    return flagged.withColumn("_new", new).withColumn("_n", F.row_number().over(w)).filter(F.col("_new") | (F.col("_n") <= room)).select("qid", "id", "score", "rank")


def _both(vector: DataFrame, side: DataFrame) -> DataFrame:
    v = vector.select("qid", "id", safe_score(F.col("score")).alias("v"), F.col("rank").alias("vr"))
    s = side.select("qid", "id", safe_score(F.col("score")).alias("s"), F.col("rank").alias("sr"))
    return v.join(s, ["qid", "id"], "full_outer")


def _numbered(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).filter(F.col("rank") <= limit).select("qid", "id", "score", "rank")


def merge_max(vector: DataFrame, side: DataFrame, limit: int) -> DataFrame:
    """The higher score of both; ties keep vector hits first."""
    rows = _both(vector, side).withColumn("score", F.greatest("v", "s"))
    return _numbered(rows, [F.desc("score"), F.col("vr").isNull(), F.coalesce("vr", "sr"), F.col("id")], limit)


def merge_prefer_sidecar(vector: DataFrame, side: DataFrame, limit: int) -> DataFrame:
    """Lexical rows in their order, then the other vector hits by score."""
    rows = _both(vector, side).withColumn("score", F.coalesce("s", "v"))
    return _numbered(rows, [F.col("sr").isNull(), "sr", F.desc("v"), "vr", "id"], limit)


def merge_blend(vector: DataFrame, side: DataFrame, limit: int, alpha: float) -> DataFrame:
    """``alpha`` of the vector and the rest of the lexical score where both have a row; lexical rows, then other vector hits."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha lies between 0 and 1")
    rows = _both(vector, side).withColumn("score", F.round(F.when(F.col("v").isNotNull() & F.col("s").isNotNull(), alpha * F.col("v") + (1 - alpha) * F.col("s")).otherwise(F.coalesce("s", "v")), 9))
    return _numbered(rows, [F.col("sr").isNull(), F.coalesce("sr", "vr"), F.col("id")], limit)
