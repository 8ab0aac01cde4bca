from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvane.plans import engine, filters
from corvane.plans.engine import Boost, Capabilities, Fusion, Index, Mmr, Prefetch, Queries, QueryPlan

POINTS = [(k, "acme", "web" if k % 2 else "mail", f"d{k}", "document", [1.0, k / 10], k) for k in range(10)]


@pytest.fixture(scope="module")
def index(spark):
    points = spark.createDataFrame(POINTS, "id long, namespace string, collection string, document_id string, content_type string, vec array<float>, year int")
    postings = points.select("id", F.lit("bm25").alias("channel"), (F.col("id") % 3).cast("int").alias("idx"), F.lit(1.0).alias("val"))
    return Index(points, postings)


@pytest.fixture(scope="module")
def queries(spark):
    return Queries(spark.createDataFrame([(1, [1.0, 0.0])], "qid long, qvec array<float>"), spark.createDataFrame([(1, "bm25", 2, 2.0)], "qid long, channel string, idx int, val double"))


def ids(df):
    return [r.id for r in df.orderBy("qid", "rank").collect()]


def test_missing_fields_are_false_and_their_negation_true(spark):
    rows = spark.createDataFrame([(1, None), (2, "a")], "id int, f string")
    assert ids_of(rows, filters.Term("f", "a")) == [2] and ids_of(rows, filters.Not(filters.Term("f", "a"))) == [1]
    assert ids_of(rows, filters.Not(filters.Range("f", gt="0"))) == [1] and ids_of(rows, filters.Or((filters.In("f", ("b",)), filters.Not(filters.Term("f", "a"))))) == [1]


def ids_of(rows, node):
    return sorted(r.id for r in filters.apply(rows, node=node).collect())


@pytest.mark.parametrize("make", [lambda: filters.In("f", ()), lambda: filters.Range("f"), lambda: filters.Geo("f", 91, 0, 1), lambda: filters.DeleteRequest("acme"), lambda: filters.Scope(" ")])
def test_wrong_filters(make):
    with pytest.raises(ValueError):
        make()


def test_empty_combinations():
    with pytest.raises(ValueError):
        filters.translate(filters.And(()))


def test_scope_and_policy(index):
    assert filters.apply(index.points, filters.Scope("acme", collections=[])).count() == 0
    assert filters.apply(index.points, filters.Scope("other")).count() == 0
    with pytest.raises(PermissionError):
        filters.Policy(namespace="acme").check(filters.Scope("other"))
    with pytest.raises(PermissionError):
        filters.Policy(collections=["web"]).check(filters.Scope("acme", collections=["mail"]))
    assert filters.Policy(collections=["web"]).check(filters.Scope("acme")).collections == ["web"]
    with pytest.raises(ValueError):
        filters.Scope("a", document_ids=["1"]).narrowed(["2"])


def test_prefetch_limits():
    assert [engine.prefetch_limit(n) for n in (1, 10, 60, 500)] == [20, 40, 200, 500]
    with pytest.raises(ValueError):
        engine.prefetch_limit(10, 5)
    assert engine.rerank_pool(10, 40) == 40 and engine.rerank_pool(10, 40, 5) == 10


@pytest.mark.parametrize("name", list(engine.PROFILES))
def test_profiles_run(index, queries, name):
    found = engine.execute(engine.profile(name, 3), index, queries)
    assert [r["rank"] for r in found.orderBy("rank").collect()] == [1, 2, 3]


def test_plans(index, queries):
    dense = engine.execute(engine.preset("dense_only", 3), index, queries)
    assert ids(dense) == [0, 1, 2]
    web = engine.execute(engine.preset("dense_only", 3), index, queries, filters.Scope("acme", collections=["web"]), filters.Range("year", gte=3))
    assert ids(web) == [3, 5, 7]
    nested = QueryPlan((Prefetch("dense", 20, (Prefetch("bm25", 20),)),), 3)
    assert ids(engine.execute(nested, index, queries)) == [2, 5, 8]
    boosted = QueryPlan((Prefetch("dense", 20),), 2, boost=Boost("gauss", "year", 9, 1))
    assert ids(engine.execute(boosted, index, queries))[0] == 9
    assert len(ids(engine.execute(QueryPlan((Prefetch("dense", 20),), 4, mmr=Mmr(0.9, 10)), index, queries))) == 4


@pytest.mark.parametrize("plan", [
    QueryPlan((), 3), QueryPlan((Prefetch("dense", 5), Prefetch("bm25", 5)), 3), QueryPlan((Prefetch("dense", 5),), 0), QueryPlan((Prefetch("nope", 5),), 3),
    QueryPlan((Prefetch("dense", 5), Prefetch("bm25", 5)), 3, Fusion("weighted_rrf", (1.0,))), QueryPlan((Prefetch("dense", 5),), 3, mmr=Mmr(1.0, 5)),
])
def test_wrong_plans(plan):
    with pytest.raises(ValueError):
        engine.validate(plan)


def test_capabilities_and_reconciling():
    with pytest.raises(ValueError):
        engine.validate(engine.preset("hybrid_dbsf", 3), Capabilities(fusions=frozenset({"rrf"})))
    plan = engine.preset("hybrid_rrf", 3)
    assert engine.reconcile(plan, {"dense"}, False).fuse is None
    with pytest.raises(ValueError):
        engine.reconcile(plan, {"dense"}, True)
    assert engine.default_plan(Capabilities(channels=frozenset({"dense"})), 3).fuse is None
    assert engine.describe_plan(plan)["channels"] == ["dense", "bm25"]


def test_variants(spark):
    q = spark.createDataFrame([(1, "a ", [" b", "b", "a", ""])], "qid int, query string, variants array<string>")
    assert [(r.variant, r["query"]) for r in engine.fan_out(q).orderBy("variant").collect()] == [(0, "a "), (1, "b")]
