"""URL expressions: parts, canonical form, redaction, host rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEAD = r"^([A-Za-z][A-Za-z0-9+.-]*)://"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _HEAD, 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _HEAD + r"(?:[^/?#@]*@)?([^/?#:]*)", 2))


def port(url: Column) -> Column:
    """The port if it is written and not the scheme's own."""
    p = F.nullif(F.regexp_extract(url, _HEAD + r"[^/?#]*?:([0-9]+)(?:[/?#]|$)", 2), F.lit(""))
    own = F.when(scheme(url) == "https", "443").when(scheme(url) == "http", "80")
    return F.when(p.eqNullSafe(own), F.lit(None)).otherwise(p)


def path(url: Column) -> Column:
    """The path with ``.`` and ``..`` segments resolved; ``/`` if there is none."""
    raw = F.regexp_extract(url, _HEAD + r"[^/?#]*([^?#]*)", 2)

    def step(acc: Column, s: Column) -> Column:
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(s == ".", acc).when(s == "..", up).otherwise(F.concat(acc, F.array(s)))

    parts = F.slice(F.split(raw, "/"), F.lit(2), F.greatest(F.size(F.split(raw, "/")) - 1, F.lit(0)))
    done = F.aggregate(parts, F.array().cast("array<string>"), step)
    tail = F.when(F.element_at(F.split(raw, "/"), -1).isin(".", ".."), "/").otherwise("")
    plain = F.when(raw == "", "/").otherwise(raw)
    return F.when(raw.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(done, "/"), F.when(F.size(done) == 0, "").otherwise(tail))).otherwise(plain)


def query(url: Column) -> Column:
    """The query without its mark; null if there is none."""
    return F.nullif(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit(""))


def has_credentials(url: Column) -> Column:
    return url.rlike(_HEAD + r"[^/?#]*@")


def allowed(url: Column, schemes: Sequence[str] = ("https",)) -> Column:
    """A scheme of the list, a host and no credentials."""
    return F.coalesce(scheme(url).isin(*schemes) & (host(url) != "") & ~has_credentials(url), F.lit(False))


def canonical(url: Column) -> Column:
    """Scheme, host, port and path in normal form: no fragment, no query, no default port."""
    return F.concat(scheme(url), F.lit("://"), host(url), F.coalesce(F.concat(F.lit(":"), port(url)), F.lit("")), path(url))


def document_key(url: Column) -> Column:
    """A stable key that tells queries apart without showing them."""
    q = query(url)
    return F.concat(F.lit("url:"), canonical(url), F.coalesce(F.concat(F.lit("|query_sha256:"), F.sha2(q.cast("binary"), 256)), F.lit("")))


def redacted(url: Column) -> Column:
    """The canonical form; a query shows as its presence only."""
    return F.concat(canonical(url), F.when(query(url).isNotNull(), "?[redacted]").otherwise(""))


def host_matches(name: Column, rule: Column) -> Column:
    """``rule`` is a host, or ``*.suffix``, which also matches the bare suffix."""
    suffix = F.substring(rule, 3, 1_000_000)
    return F.when(F.startswith(rule, F.lit("*.")), (name == suffix) | F.endswith(name, F.concat(F.lit("."), suffix))).otherwise(name == rule)


def host_allowed(name: Column, rules: Sequence[str]) -> Column:
    """Whether any rule matches; no rules allow nothing."""
    out = F.lit(False)
    for r in rules:
        out = out | host_matches(name, F.lit(r.lower()))
    return F.coalesce(out, F.lit(False))
