"""Vector and distance expressions over ``array<float>`` columns; all arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of one dimension; zero if either has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def distance_score(distance: Column, metric: str = "cosine") -> Column:
    """Score of a distance: ``1 - min(d, 2)`` for cosine, else ``1 / (1 + d)``."""
    return 1 - F.least(distance, F.lit(2.0)) if metric == "cosine" else 1 / (1 + distance)


def haversine_m(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Great-circle distance in metres."""
    p, q = F.radians(lat), F.radians(F.lit(lat0))
    a = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin((F.radians(F.lit(lon0)) - F.radians(lon)) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def trigrams(text: Column) -> Column:
    """Distinct three-character windows of the text with two blanks at each end."""
    padded = F.concat(F.lit("  "), text, F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays without repeats."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def valid_vector(vector: Column, dimension: int) -> Column:
    """Right dimension and all elements finite."""
    return F.coalesce((F.size(vector) == dimension) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
