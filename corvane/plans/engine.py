"""Query plans: an immutable description of a retrieval, checked, then lowered to one DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import fusion
from corvane.operators.retrieve import ranked, dense_topk, sparse_topk
from corvane.plans.filters import Filter, Policy, Scope, apply, describe

RRF_K = 60
MAX_VARIANTS = 8


@dataclass(frozen=True)
class Prefetch:
    """One channel: ``dense``, or a named sparse channel; ``within`` are channels whose hits alone are scored."""

    channel: str
    limit: int
    within: tuple[Prefetch, ...] = ()


@dataclass(frozen=True)
class Fusion:
    kind: str = "rrf"  # rrf, weighted_rrf, dbsf
    weights: tuple[float, ...] = ()
    k: int = RRF_K


@dataclass(frozen=True)
class Mmr:
    diversity: float
    limit: int


@dataclass(frozen=True)
class Boost:
    kind: str
    field: str
    target: float
    scale: float
    midpoint: float = 0.5


@dataclass(frozen=True)
class QueryPlan:
    prefetches: tuple[Prefetch, ...]
    final_limit: int
    fuse: Fusion | None = None
    mmr: Mmr | None = None
    boost: Boost | None = None
    profile: str | None = None


@dataclass(frozen=True)
class Capabilities:
    """What an index can do. This engine can do all of it; an index without sparse rows says so."""

    channels: frozenset[str] = frozenset({"dense", "bm25", "splade"})
    fusions: frozenset[str] = frozenset({"rrf", "weighted_rrf", "dbsf"})
    mmr: bool = True
    boost: bool = True
    nested: bool = True


def prefetch_limit(limit: int, requested: int | None = None) -> int:
    """Four times the limit, from 20 to 200, but the limit at least; a requested one must reach the limit."""
    if limit <= 0:
        raise ValueError("a limit is positive")
    if requested is not None:
        if requested < limit:
            raise ValueError("a prefetch limit reaches the limit")
        return requested
    return max(min(max(4 * limit, 20), 200), limit)


def rerank_pool(limit: int, prefetch: int, requested: int | None = None) -> int:
    return max(prefetch, limit) if requested is None else max(requested, limit)


def preset(name: str, limit: int, channels: Sequence[str] = ("bm25",)) -> QueryPlan:
    n = prefetch_limit(limit)
    dense, sparse = Prefetch("dense", n), tuple(Prefetch(c, n) for c in channels)
    plans: dict[str, Callable[[], QueryPlan]] = {
        "hybrid_rrf": lambda: QueryPlan((dense, *sparse), limit, Fusion()),
        "hybrid_dbsf": lambda: QueryPlan((dense, *sparse), limit, Fusion("dbsf")),
        "dense_only": lambda: QueryPlan((dense,), limit),
        "sparse_only": lambda: QueryPlan((Prefetch("bm25", n),), limit),
        "hybrid_with_mmr": lambda: QueryPlan((dense, *sparse), limit, Fusion(), mmr=Mmr(0.5, n)),
    }
    if name not in plans:
        raise ValueError(f"unknown preset {name!r}; there are {', '.join(plans)}")
    return plans[name]()


#: Profiles by name; the first is the default.
PROFILES = {"fast": "dense_only", "balanced": "hybrid_rrf", "lexical": "sparse_only", "coverage": "hybrid_dbsf", "diverse": "hybrid_with_mmr"}


def profile(name: str, limit: int) -> QueryPlan:
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}; there are {', '.join(PROFILES)}")
    return replace(preset(PROFILES[name], limit), profile=name)


def default_plan(caps: Capabilities, limit: int) -> QueryPlan:
    sparse = sorted(caps.channels - {"dense"})
    if "dense" not in caps.channels:
        return preset("sparse_only", limit)
    return preset("hybrid_rrf", limit, sparse) if sparse and "rrf" in caps.fusions else preset("dense_only", limit)


def validate(plan: QueryPlan, caps: Capabilities = Capabilities()) -> QueryPlan:
    """The plan, or an error before any work; nothing is downgraded silently."""
    if not plan.prefetches or plan.final_limit <= 0:
        raise ValueError("a plan has a channel and a positive limit")
    if len(plan.prefetches) > 1 and plan.fuse is None:
        raise ValueError("several channels need a fusion")
    if plan.fuse is not None:
        if plan.fuse.kind not in caps.fusions:
            raise ValueError(f"fusion {plan.fuse.kind!r}")
        if (plan.fuse.kind == "weighted_rrf") != bool(plan.fuse.weights) or plan.fuse.weights and len(plan.fuse.weights) != len(plan.prefetches):
            raise ValueError("weighted_rrf, and only it, has a weight for each channel")
    if plan.mmr is not None and (not caps.mmr or not 0 < plan.mmr.diversity < 1):
        raise ValueError("mmr")
    if plan.boost is not None and not caps.boost:
        raise ValueError("boost")

    def check(p: Prefetch) -> None:
        if p.channel not in caps.channels or p.limit <= 0 or p.within and not caps.nested:
            raise ValueError(f"channel {p.channel!r}")
        for x in p.within:
            check(x)

    for p in plan.prefetches:
        check(p)
    return plan


def reconcile(plan: QueryPlan, available: set[str], explicit: bool) -> QueryPlan:
    """An implicit plan without the channels that a query has no vector for; an explicit one is an error then."""
    missing = [p.channel for p in plan.prefetches if p.channel not in available]
    if not missing:
        return plan
    kept = tuple(p for p in plan.prefetches if p.channel in available)
    if explicit or not kept:
        raise ValueError(f"no query vector for {missing}")
    return replace(plan, prefetches=kept, fuse=plan.fuse if len(kept) > 1 else None)


def describe_plan(plan: QueryPlan, node: Filter | None = None) -> dict[str, Any]:
    return {
        "profile": plan.profile, "channels": [p.channel for p in plan.prefetches], "limits": [p.limit for p in plan.prefetches], "fusion": plan.fuse.kind if plan.fuse else None,
        "rerank": "mmr" if plan.mmr else None, "boost": plan.boost.kind if plan.boost else None, "filter": describe(node), "final_limit": plan.final_limit,
    }


@dataclass(frozen=True)
class Index:
    """The tables of an index: points (id, namespace, collection, document_id, ..., vec) and postings (id, channel, idx, val)."""

    points: DataFrame
    postings: DataFrame | None = None
    capabilities: Capabilities = field(default_factory=Capabilities)


@dataclass(frozen=True)
class Queries:
    """A batch: dense (qid, qvec) and sparse (qid, channel, idx, val)."""

    dense: DataFrame | None = None
    sparse: DataFrame | None = None


def execute(plan: QueryPlan, index: Index, queries: Queries, scope: Scope | None = None, node: Filter | None = None, policy: Policy | None = None) -> DataFrame:
    """(qid, id, score, rank). Scope and filter are applied once, before the channels branch."""
    validate(plan, index.capabilities)
    if policy is not None:
        scope = policy.check(scope or Scope())
    points = apply(index.points, scope, node)

    def channel(p: Prefetch) -> DataFrame:
        limit = p.limit if not p.within else 2**31 - 1
        allowed = None
        for x in p.within:
            hits = channel(x).select("qid", "id")
            allowed = hits if allowed is None else allowed.unionByName(hits)
        if p.channel == "dense":
            out = dense_topk(queries.dense, points.select("id", "vec"), limit)
        else:
            own = index.postings.filter(F.col("channel") == p.channel).join(points.select("id"), "id", "left_semi")
            out = sparse_topk(queries.sparse.filter(F.col("channel") == p.channel), own, limit)
        return out if allowed is None else fusion.nested(out, allowed, p.limit)

    hits = [channel(p) for p in plan.prefetches]
    wide = plan.final_limit if plan.boost is None and plan.mmr is None else max(p.limit for p in plan.prefetches)
    if len(hits) == 1:
        out = ranked(hits[0].drop("rank"), wide)
    elif plan.fuse.kind == "dbsf":
        out = fusion.dbsf(hits, wide)
    else:
        out = fusion.rrf(hits, wide, plan.fuse.k, plan.fuse.weights or None)
    if plan.boost is not None:
        b = plan.boost
        out = fusion.boost(out.join(points.select("id", F.col(b.field).alias("_f")), "id"), F.col("_f"), b.kind, b.target, b.scale, b.midpoint).drop("_f")
    if plan.mmr is not None:
        out = fusion.mmr(out.join(points.select("id", "vec"), "id"), plan.mmr.diversity, plan.final_limit, plan.mmr.limit)
    return out.filter(F.col("rank") <= plan.final_limit).select("qid", "id", "score", "rank")


def variants(query: Column, more: Column, most: int = MAX_VARIANTS) -> Column:
    """Variants of a query: trimmed, distinct, not the query itself, ``most`` at most."""
    return F.slice(F.filter(F.array_except(F.array_distinct(F.transform(more, lambda v: F.trim(v))), F.array(F.trim(query))), lambda v: v != ""), 1, most)


def fan_out(queries: DataFrame) -> DataFrame:
    """One row for the query (variant 0) and each of its variants; all run in one plan and meet in a fusion."""
    return queries.select("qid", F.posexplode(F.concat(F.array("query"), variants(F.col("query"), F.col("variants")))).alias("variant", "query"))


def pipeline(df: DataFrame, *stages: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Stages one after another; ``None`` is a stage that changes nothing."""
    for s in stages:
        df = df if s is None else df.transform(s)
    return df
