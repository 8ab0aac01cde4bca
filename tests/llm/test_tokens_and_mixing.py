"""Encoding, token files, attribution, mixing and quality rules."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corvane.llm import mixing, quality, token_counts, token_files
from corvane.llm.encoding import PieceEncoder
from corvane.llm.queries import vocabulary

PATH = vocabulary()
ODD = ["", " ", "\n\n  x", "it's they'll I'M", "été çà naïve", "a.b,c 12345 6.7%", "<|endoftext|> x", "日本語 テスト", "emoji 👩‍👩‍👧 ok", "a b　c d", "tab\tand\r\nnew", "ß.ß, end", "x" * 3000, "ǅ ʰ", "don't. stop,  now"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def check_encoding(texts, library):
    for t, ids in zip(texts, PieceEncoder(PATH).encode(texts), strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_odd_texts(library):
    check_encoding(ODD, library)


def test_pieces_are_forgotten_when_there_are_too_many(library):
    enc = PieceEncoder(PATH, room=40)
    for _ in range(3):
        for k in range(0, len(ODD), 3):
            for t, ids in zip(ODD[k : k + 3], enc.encode(ODD[k : k + 3]), strict=True):
                assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
    assert len(enc.number) < 100


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" .,\n'sabcéñ19\t ")), max_size=60), max_size=6))
def test_encoding_equals_the_library(library, texts):
    check_encoding(texts, library)


def test_direct_codes():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 300, 3000), rng.integers(0, 2**32, 500), [0, 255, 256, 65535, 65536, 2**32 - 1]]).astype(np.uint32)
    codes = token_files.DirectCodes.from_row(token_files.DirectCodes.pack(ids).to_row())
    assert codes.unpack().tolist() == ids.tolist()
    assert [codes.get(k) for k in range(0, len(ids), 97)] == ids[::97].tolist()
    assert token_files.DirectCodes.pack(np.zeros(0, np.uint32)).unpack().tolist() == []
    with pytest.raises(IndexError):
        codes.get(len(ids))


def test_token_files(spark, tmp_path, library):
    rows = [(k, t, 1) for k, t in enumerate(ODD)] + [(100, None, 1), (100, "", 1), (None, "first", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(3)
    path = token_files.write_tokens(docs, f"file://{tmp_path}/t", PATH, segment_tokens=64)
    found = sorted(token_files.read_documents(spark, path, with_tokens=True).collect(), key=lambda r: r.start)
    assert found[0].id is None and [r.id for r in found[1:]] == sorted(r[0] for r in rows[:-1])
    flat, want = [], {}
    for r in found:
        assert r.start == len(flat) and r.n_tokens == len(r.tokens) and r.tokens[-1] == 2
        assert r.ids_crc32 == zlib.crc32(np.array(r.tokens, "<u4").tobytes())
        flat += r.tokens
        want.setdefault(r.id, []).append(r.tokens[:-1])
    for key, t, _ in rows:
        assert library.encode(t or "", add_special_tokens=False).ids in want[key]
    for at in (0, 1, len(flat) // 2, len(flat) - 1):
        assert token_files.token_at(spark, path, at) == flat[at]
    assert token_files.token_digest(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("rule", ["start", "majority"])
def test_section_tokens(spark, library, rule):
    texts = [*ODD, "one\ntwo three\n\nfour", "a\n", "日\n本"]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    found = token_counts.section_tokens(docs, PATH, rule=rule).collect()
    total = Counter()
    for r in found:
        total[r.id] += r.n_tokens
        assert r.start_char < r.end_char <= len(texts[r.id])
    assert {k: total[k] for k in total} == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts) if t}
    with pytest.raises(ValueError, match="other"):
        token_counts.allot(np.array([1]), np.ones(5, np.int64), b"ab", np.array([0, 2]), "other")


@pytest.mark.parametrize("rule", ["start", "majority"])
def test_sections_of_another_tokenizer(spark, rule):
    """A vocabulary whose words cannot be cut into pieces: ids and spans are the library's own, token by token."""
    path = vocabulary("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    texts = [t for t in ODD if t] + ["One line\nTwo lines\n\nthree", "ÀÉ\n  x y\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in token_counts.section_tokens(docs, path, rule=rule).orderBy("id", "section").collect():
        got.setdefault(r.id, []).append(r.n_tokens)
    for k, t in enumerate(texts):
        want = [0] * len(got[k])
        ends = np.cumsum([len(x) for x in t.split("\n")]) + np.arange(1, t.count("\n") + 2)
        for a, b in whole.encode(t, add_special_tokens=False).offsets:
            held = [int(np.searchsorted(ends, c, "right")) for c in range(a, max(b, a + 1))]
            pick = min(held[0], len(want) - 1) if rule == "start" else min(max(sorted(set(held)), key=held.count), len(want) - 1)
            want[pick] += 1
        assert got[k] == want


def test_crossing_tokens_by_rule():
    ids, lengths, raw = np.array([0, 1]), np.array([4, 2]), b"abcdef"
    bounds = np.array([0, 1, 6])
    assert token_counts.allot(ids, lengths, raw, bounds, "start")[0].tolist() == [1, 1]
    assert token_counts.allot(ids, lengths, raw, bounds, "majority")[0].tolist() == [0, 2]
    assert token_counts.allot(ids, lengths, raw, bounds, "majority")[1].tolist() == [0, 1]


def test_field_tokens(spark, library):
    found = token_counts.field_tokens(spark.createDataFrame([(1, "ab", None), (2, "x", "y z")], "k long, a string, b string"), ["a", "b"], PATH, "k").collect()
    assert sum(r.n_tokens for r in found if r.id == 2) == len(library.encode("x\ny z", add_special_tokens=False).ids)


def mix_corpus(n=600):
    rng = random.Random(3)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choice(["a", "b", "b", "b", "z", None])) for k in range(n)]
    return [*rows, (7, None, "a"), (7, None, "a"), (8, "w w", "b"), (8, "w w", "b")]


@pytest.mark.parametrize("bucket_rows", [4096, 16])
def test_mix(spark, bucket_rows):
    rows = mix_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs, bucket_rows=bucket_rows, fan_in=3).collect()
    assert len(found) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    goal = mixing.targets(dict(size))
    taken, largest = Counter(), Counter()
    for r in found:
        assert r.source_size == size[r.source] and abs(r.target - goal[r.source]) < 1e-6
        assert 0 <= r.copies <= 3 and (r.size or not r.copies)
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    for s in size:
        assert abs(taken[s] - goal[s]) <= largest[s]
    again = mixing.mix(docs.repartition(7), bucket_rows=bucket_rows, fan_in=3).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_targets():
    t = mixing.targets({"a": 10, "b": 1000, None: 500})
    assert t["a"] == 30 and abs(sum(t.values()) - 1510) < 1e-9
    assert mixing.targets({"a": 0, None: 0}) == {"a": 0, None: 0}
    assert mixing.targets({}) == {}


def test_targets_of_many_sources(spark):
    rng = random.Random(12)
    rows = [(k, "w " * rng.choice([0, 1, 2, 3, 50, 400]), None if k % 11 == 0 else chr(rng.choice([97, 0xE9, 0xFFFD, 0x1F600]) + rng.randrange(8))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = ({(r.id, r.source): (r.size, r.source_size, r.target) for r in mixing.mix(docs, driver_sources=n).collect()} for n in (100_000, 2))
    assert a.keys() == b.keys() and all(a[k][:2] == b[k][:2] and abs(a[k][2] - b[k][2]) < 1e-6 for k in a)


def test_repeated_rows_are_each_taken_for_themselves(spark):
    docs = spark.createDataFrame([(1, "a b", "x", k) for k in range(3)] + [(2, "c d e f", "y", 9)], "doc_id long, text string, source string, copies int")
    assert {r["copies"] for r in mixing.repeat_by_copies(docs).collect() if r.doc_id == 1} == {0, 1, 2}


def test_repeat_by_copies(spark):
    rows = mix_corpus(200)
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, size int")
    out = mixing.repeat_by_copies(docs)
    assert out.columns == docs.columns
    words = sum(len((r.text or "").split()) for r in out.collect())
    assert abs(words - sum(len((r[1] or "").split()) for r in rows)) <= 4 * 300
    assert mixing.repeat_by_copies(docs.limit(0)).count() == 0


def report(text: str | None) -> tuple:
    t = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    rep = {j for i in range(len(ws) - 2) if tri[tuple(ws[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(ws)
    return n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), n < 50 or 100 * len(rep) > 50 * n


def test_quality_report(spark):
    rng = random.Random(8)
    texts = [None, "", " \n ", "a b c a b c", "x " * 60, "\n".join(["same line here"] * 30), "# " * 100, "ÀÉ WORDS " * 40]
    texts += [" ".join(rng.choice(["the", "of", "tree", "house", "\n", "###"]) + str(rng.randint(0, 40)) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    docs = spark.createDataFrame([(k, t, 3) for k, t in enumerate(texts)], "doc_id long, text string, n_words int")
    found = quality.quality_report(docs).collect()
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == report(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in found if r.kept)
    assert quality.quality_report(docs.limit(0)).count() == 0


def test_order_of_rules_does_not_change_a_verdict(spark):
    docs = spark.createDataFrame([(k, "word%d " % k * k) for k in range(40, 90)], "doc_id long, text string")
    a = {r.doc_id: r.kept for r in quality.quality_report(docs, sample_rows=1).collect()}
    assert a == {r.doc_id: r.kept for r in quality.quality_report(docs, sample_rows=50).collect()}


def test_rules_are_ordered_by_rejection_per_cost(spark):
    """A rule that rejects most at no cost comes first, one that rejects nothing dearly comes last."""
    docs = spark.createDataFrame([(k, "word%d other " % k * (400 if k % 4 == 0 else 10)) for k in range(200)], "doc_id long, text string")
    rules = lambda m: [quality.Rule("dear", m["n_repeat_words"] < 0), quality.Rule("cheap", m["n_words"] < 50), quality.Rule("mild", m["n_upper"] > 10**6)]
    assert quality.order_rules(docs, rules)[0] == "cheap"
    costs = {name: (share, cost) for name, share, cost in quality.rule_costs(docs, rules)}
    assert abs(costs["cheap"][0] - 0.75) < 0.1 and costs["dear"][0] == 0 and costs["dear"][1] > costs["cheap"][1]
