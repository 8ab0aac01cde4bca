"""Deterministic identities as expressions: name-based UUIDs, document and point ids, Adler-32, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RFC 4122's namespace for URLs.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """RFC 4122 version 5 UUID of ``name`` in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def document_id(namespace: Column, collection: Column, key: Column) -> Column:
    return F.concat(F.lit("doc_"), uuid5(F.concat_ws("::", namespace, collection, key)))


def point_id(namespace: Column, collection: Column, document: Column, chunk_index: Column) -> Column:
    return uuid5(F.concat(F.concat_ws("::", namespace, collection, document), F.lit(":chunk:"), chunk_index.cast("string")))


def adler32(text: Column) -> Column:
    """Adler-32 of an ASCII string, as a long."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))

    def add(acc: Column, x: Column) -> Column:
        a = (acc["a"] + x) % 65521
        return F.struct(a.alias("a"), ((acc["b"] + a) % 65521).alias("b"))

    return F.aggregate(codes, start, add, lambda s: s["b"] * 65536 + s["a"])


def content_fingerprint(*parts: tuple[str, Column]) -> Column:
    """SHA-256 of the parts as compact JSON with sorted keys."""
    fields = [F.concat(F.lit(f'"{k}":'), F.coalesce(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(v.cast("string"), r"\\", r"\\\\"), '"', r'\\"'), F.lit('"')), F.lit("null"))) for k, v in sorted(parts, key=lambda p: p[0])]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")), 256)


def short_hash(text: Column, n: int = 12) -> Column:
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(n))
