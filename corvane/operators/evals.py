"""Retrieval quality: hits (case_id, doc_id, rank) against grades (case_id, doc_id, grade)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _judged(hits: DataFrame, grades: DataFrame) -> DataFrame:
    """Hits with their grade; a document counts at its first rank only, but keeps the places it takes."""
    first = Window.partitionBy("case_id", "doc_id").orderBy("rank")
    graded = hits.join(grades.filter("grade > 0"), ["case_id", "doc_id"], "left")
    return graded.withColumn("gain", F.when(F.row_number().over(first) == 1, F.coalesce("grade", F.lit(0))).otherwise(0))


def case_metrics(hits: DataFrame, grades: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """Per case with a relevant document: n_relevant, recall, reciprocal_rank, ndcg at ``k``."""
    good = grades.filter("grade > 0")
    ideal_rank = Window.partitionBy("case_id").orderBy(F.desc("grade"), "doc_id")
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1.0)
    ideal = good.withColumn("r", F.row_number().over(ideal_rank)).groupBy("case_id").agg(F.count(F.lit(1)).alias("n_relevant"), F.sum(F.when(F.col("r") <= k, gain(F.col("grade"), F.col("r"))).otherwise(0.0)).alias("best"))
    got = _judged(hits, good).groupBy("case_id").agg(
        F.count_if((F.col("gain") > 0) & (F.col("rank") <= k)).alias("found"), F.min(F.when(F.col("gain") > 0, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= k, gain(F.col("gain"), F.col("rank"))).otherwise(0.0)).alias("dcg"),
    )
    return ideal.join(got, "case_id", "left").select(
        "case_id", "n_relevant", F.round(F.coalesce(F.col("found") / F.col("n_relevant"), F.lit(0.0)), digits).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), digits).alias("reciprocal_rank"), F.round(F.coalesce(F.col("dcg") / F.col("best"), F.lit(0.0)), digits).alias("ndcg"),
    )


def report(cases: DataFrame, digits: int = 6) -> DataFrame:
    """Means over cases, latency at the 95th percentile (nearest rank) and queries a second, one after another."""
    return cases.agg(
        F.count(F.lit(1)).alias("cases"), F.round(F.avg("recall"), digits).alias("recall"), F.round(F.avg("reciprocal_rank"), digits).alias("mrr"), F.round(F.avg("ndcg"), digits).alias("ndcg"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").alias("p95_ms"), F.round(F.count(F.lit(1)) * 1000.0 / F.sum("latency_ms"), digits).alias("qps"),
    )


def resolve_ids(hits: DataFrame, known: DataFrame) -> DataFrame:
    """``resolved``: the first of id, document_id and document_key that is a known id, else the document's or the hit's own."""
    k = known.select("known").distinct()
    out = hits
    for n, c in enumerate(("id", "document_id", "document_key")):
        out = out.join(k.select(F.col("known").alias(f"_k{n}")), F.col(c) == F.col(f"_k{n}"), "left")
    return out.withColumn("resolved", F.coalesce("_k0", "_k1", "_k2", "document_id", "id")).drop("_k0", "_k1", "_k2")


def context_checks(contexts: DataFrame) -> DataFrame:
    """Per case (case_id, text, expected, forbidden, citations, min_citations, max_chars): what the packed context holds."""
    has = lambda s: F.contains(F.lower("text"), F.lower(s))
    return contexts.select(
        "case_id", F.forall("expected", has).alias("contains_all"), F.size(F.filter("forbidden", has)).alias("leaks"),
        (F.col("citations") >= F.col("min_citations")).alias("enough_citations"), (F.col("max_chars").isNull() | (F.length("text") <= F.col("max_chars"))).alias("within_budget"),
    )


def returned_documents(hits: DataFrame, most: int = 64) -> DataFrame:
    """Distinct documents of a query in the order of their best rank, ``most`` at most (the event's own limit)."""
    first = hits.groupBy("qid", "document_id").agg(F.min("rank").alias("rank"))
    n = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "document_id"))
    return first.withColumn("place", n).filter(F.col("place") <= most).select("qid", "document_id", "place")
