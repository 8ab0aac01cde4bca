"""Filter trees and their one translation, into two-valued Columns.

A leaf over a missing field is false, not unknown; ``Not`` of it is therefore true.
Every leaf is coalesced before it is combined.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.vectors import haversine_m

FALSE = F.lit


@dataclass(frozen=True)
class Term:
    field: str
    value: Any


@dataclass(frozen=True)
class In:
    field: str
    values: Sequence[Any]

    def __post_init__(self):
        if not self.values:
            raise ValueError("In needs a value")


@dataclass(frozen=True)
class Range:
    """Numbers by value, strings by code points (ISO dates sort as they should)."""

    field: str
    gte: Any = None
    gt: Any = None
    lte: Any = None
    lt: Any = None

    def __post_init__(self):
        if all(b is None for b in (self.gte, self.gt, self.lte, self.lt)):
            raise ValueError("Range needs a bound")


@dataclass(frozen=True)
class Geo:
    """Points within ``radius_m``, its border included; the field is a struct of lat and lon."""

    field: str
    lat: float
    lon: float
    radius_m: float

    def __post_init__(self):
        if not (-90 <= self.lat <= 90 and -180 <= self.lon <= 180 and self.radius_m > 0):
            raise ValueError("Geo needs a point on Earth and a positive radius")


@dataclass(frozen=True)
class And:
    parts: Sequence[Any]


@dataclass(frozen=True)
class Or:
    parts: Sequence[Any]


@dataclass(frozen=True)
class Not:
    part: Any


Filter = Term | In | Range | Geo | And | Or | Not


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def translate(node: Filter, column: Callable[[str], Column] = F.col) -> Column:
    """The Column of a filter tree; ``column`` finds a field, e.g. in a payload map."""
    match node:
        case Term(name, value):
            return _sure(column(name) == F.lit(value))
        case In(name, values):
            return _sure(column(name).isin(*values))
        case Range(name, gte, gt, lte, lt):
            c = column(name)
            parts = [op for bound, op in ((gte, lambda b: c >= b), (gt, lambda b: c > b), (lte, lambda b: c <= b), (lt, lambda b: c < b)) if bound is not None for op in [op(F.lit(bound))]]
            return _sure(reduce(and_, parts))
        case Geo(name, lat, lon, radius):
            c = column(name)
            return _sure(haversine_m(c["lat"], c["lon"], lat, lon) <= radius)
        case And(parts) if parts:
            return reduce(and_, (translate(p, column) for p in parts))
        case Or(parts) if parts:
            return reduce(or_, (translate(p, column) for p in parts))
        case Not(part):
            return ~translate(part, column)
    raise ValueError(f"not a filter: {node!r}")


def describe(node: Filter | None) -> str | None:
    return None if node is None else type(node).__name__.lower()


@dataclass(frozen=True)
class Scope:
    """Who may see which rows. An allow-list that is empty lets nothing through; ``None`` is no list."""

    namespace: str = "default"
    collections: Sequence[str] | None = None
    content_types: Sequence[str] | None = None
    document_ids: Sequence[str] | None = None

    def __post_init__(self):
        if not (self.namespace or "").strip():
            raise ValueError("a blank namespace")

    def column(self) -> Column:
        out = F.col("namespace") == self.namespace
        for name, listed in (("collection", self.collections), ("content_type", self.content_types), ("document_id", self.document_ids)):
            if listed is not None:
                out = out & (F.col(name).isin(*listed) if listed else F.lit(False))
        return _sure(out)

    def narrowed(self, document_ids: Sequence[str] | None) -> Scope:
        """For requested documents, which must all be in the configured set."""
        if document_ids is not None and self.document_ids is not None and (extra := sorted(set(document_ids) - set(self.document_ids))):
            raise ValueError(f"documents out of scope: {extra}")
        return Scope(self.namespace, self.collections, self.content_types, self.document_ids if document_ids is None else document_ids)


@dataclass(frozen=True)
class Policy:
    """What a caller may do: a bound namespace, collections, and switches for costly stages."""

    namespace: str | None = None
    collections: Sequence[str] | None = None
    allow_rerank: bool = True
    allow_lexical: bool = True
    presets: Sequence[str] | None = None

    def check(self, scope: Scope, rerank: bool = False, lexical: bool = False, preset: str | None = None) -> Scope:
        """The scope with this policy's limits, or an error."""
        if self.namespace is not None and scope.namespace != self.namespace:
            raise PermissionError(f"namespace {scope.namespace!r}")
        if rerank and not self.allow_rerank or lexical and not self.allow_lexical:
            raise PermissionError("stage not allowed")
        if preset is not None and self.presets is not None and preset not in self.presets:
            raise PermissionError(f"preset {preset!r}")
        if self.collections is None:
            return scope
        asked = self.collections if scope.collections is None else scope.collections
        if extra := sorted(set(asked) - set(self.collections)):
            raise PermissionError(f"collections {extra}")
        return Scope(scope.namespace, list(asked), scope.content_types, scope.document_ids)


def apply(df: DataFrame, scope: Scope | None = None, node: Filter | None = None) -> DataFrame:
    """Rows in scope that pass the filter; both reach the scan."""
    out = df if scope is None else df.filter(scope.column())
    return out if node is None else out.filter(translate(node))


@dataclass(frozen=True)
class DeleteRequest:
    """What to delete: a namespace with a collection or a document, never a whole namespace."""

    namespace: str
    collection: str | None = None
    document_ids: Sequence[str] = field(default_factory=tuple)

    def __post_init__(self):
        if not self.namespace.strip() or not ((self.collection or "").strip() or self.document_ids):
            raise ValueError("a delete needs a namespace and a collection or documents")

    def column(self) -> Column:
        out = F.col("namespace") == self.namespace
        if self.collection is not None:
            out = out & (F.col("collection") == self.collection)
        if self.document_ids:
            out = out & F.col("document_id").isin(*self.document_ids)
        return _sure(out)


def parse_pairs(pairs: Sequence[str]) -> Filter | None:
    """``field=value`` strings to a conjunction of terms."""
    terms = []
    for p in pairs:
        name, sep, value = p.partition("=")
        if not sep or not name.strip():
            raise ValueError(f"not field=value: {p!r}")
        terms.append(Term(name.strip(), value))
    return None if not terms else terms[0] if len(terms) == 1 else And(terms)
