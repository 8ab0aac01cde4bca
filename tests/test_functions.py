from __future__ import annotations

import math
import uuid
import zlib

import pytest
from pyspark.sql import functions as F

from corvane.functions import identity, text, urls, vectors


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first().r


def test_uuid5(spark):
    for name in ("", "acme::web::1", "é::x", "a" * 300):
        assert one(spark, name, identity.uuid5) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_adler32(spark):
    for name in ("", "a", "invoice", "token" * 2000):
        assert one(spark, name, identity.adler32) == zlib.adler32(name.encode())


@pytest.mark.parametrize(("value", "want"), [("", 0), ("abcd", 1), ("abcde", 2), ("a b", 2), ("été x!", 5), ("日本", 2), ("a_b9 ..", 3)])
def test_token_estimate(spark, value, want):
    from corvane.operators.chunking import tokens

    assert one(spark, value, text.token_estimate) == want == tokens(value)


def test_quality(spark):
    q = lambda v: one(spark, v, text.quality)
    assert q(None).verdict == q("  \n").verdict == "empty"
    assert q("short").verdict == "poor" and q("words and more words. " * 5).verdict == "good"
    assert q("#" * 80 + "a").verdict == "poor" and q("ab " * 20 + "�" * 20).verdict == "poor"
    assert q("  " + "x" * 60 + "  ").char_count == 60


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = row.select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.cosine(F.col("a"), F.col("z")).alias("z"), vectors.valid_vector(F.col("a"), 2).alias("v"), vectors.valid_vector(F.col("a"), 3).alias("w")).first()
    assert abs(r.c - math.sqrt(0.5)) < 1e-12 and r.z == 0 and r.v and not r.w
    km = spark.range(1).select(vectors.haversine_m(F.lit(52.52), F.lit(13.405), 48.137, 11.575).alias("m")).first().m / 1000
    assert 503 < km < 506


@pytest.mark.parametrize(("url", "want"), [
    ("HTTPS://User@Ex.com:443/a/./b/../c?q=1#f", "https://ex.com/a/c"), ("http://ex.com", "http://ex.com/"), ("http://ex.com:8080/x", "http://ex.com:8080/x"), ("https://ex.com/../..", "https://ex.com/"),
])
def test_canonical_url(spark, url, want):
    assert one(spark, url, urls.canonical) == want


def test_url_rules(spark):
    assert not one(spark, "https://u:p@ex.com/", urls.allowed) and not one(spark, "http://ex.com/", urls.allowed) and one(spark, "https://ex.com", urls.allowed)
    assert one(spark, "a.ex.com", lambda c: urls.host_allowed(c, ["*.ex.com"])) and one(spark, "ex.com", lambda c: urls.host_allowed(c, ["*.ex.com"]))
    assert not one(spark, "notex.com", lambda c: urls.host_allowed(c, ["*.ex.com"])) and not one(spark, "ex.com", lambda c: urls.host_allowed(c, []))
    assert one(spark, "https://e.com/a?k=secret", urls.redacted) == "https://e.com/a?[redacted]"


@pytest.mark.parametrize(("value", "want"), [(None, False), ("ab", False), ("plain text", False), ("a\ue000bc", True), ("\u0101\u0102\u0103abcd\u0301", True), ("\x01\x02\x03a", True), ("caf\u00e9 na\u00efve", False)])
def test_garbled(spark, value, want):
    assert one(spark, value, text.garbled) is want


def test_slug_and_sections(spark):
    assert one(spark, " My  Docs-2024! ", text.slug) == "my_docs-2024"
    assert one(spark, "A > B > C ", text.last_section) == "C" and one(spark, "", text.last_section) is None
    assert one(spark, "Héllo,  WORLD!", text.lexical_form) == "héllo world"
