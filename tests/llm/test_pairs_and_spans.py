"""SimHash groups, exact spans and phrase matches against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from corvane.llm import decontam, mixing, simhash, suffix_dedup

DOCS = "doc_id long, text string, fp string, id int"  # the last two clash with names in use


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n)]


def near_corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(0, None), (1, ""), (2, "  \n"), (3, "one"), (4, "ONE"), (5, "a b c d"), (5, "a b c d"), (None, "a b c d")]
    key = 6
    for _ in range(12):
        base = words(rng, rng.randint(30, 120))
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((key, " ".join(copy)))
            key += 1
    return [(i, t, "x", 7) for i, t in rows]


def fingerprint(text: str | None) -> int:
    ws = "".join(c.lower() if c.isascii() else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", ws)
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 4]) for i in range(max(len(ws) - 3, 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows: list[tuple]) -> list[int | None]:
    fps = [fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return [least.get(find(k)) for k in range(len(rows))]


@pytest.mark.parametrize(("seed", "block_rows"), [(1, 4096), (2, 5)])
def test_near_duplicates(spark, seed, block_rows):
    rows = near_corpus(seed)
    want = sorted(((r[0], fingerprint(r[1]), c) for r, c in zip(rows, components(rows), strict=True)), key=str)
    found = simhash.near_duplicates(spark.createDataFrame(rows, DOCS), block_rows=block_rows).collect()
    assert sorted(((r.id, r.fp & (2**64 - 1), r.component) for r in found), key=str) == want


def test_keep_one(spark):
    rows = near_corpus(3)
    heads = {c for c in components(rows)}
    kept = [r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(heads - {None})
    assert kept.count(None) == 0  # its component has ids


def test_keep_one_tells_rows_of_one_id_apart(spark):
    rng = random.Random(8)
    a, b, c, d = (" ".join(words(rng, 60)) for _ in range(4))
    rows = [(1, a), (1, b), (2, b), (3, c), (5, c), (5, d), (None, d + " x y"), (None, a[::-1]), (None, a[::-1]), (5, d)]
    kept = simhash.keep_one(spark.createDataFrame([(i, t, "x", 7) for i, t in rows], DOCS)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept if r.doc_id is not None), key=str) == sorted([(1, a), (1, b), (3, c), (5, d)], key=str)
    assert [r.text for r in kept if r.doc_id is None].count(a[::-1]) == 1


def test_bit_sliced_distances():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)), rng.integers(0, 2**63, 300, dtype=np.uint64)])
    root = simhash.linked(np.full(len(fps), len(fps)), fps, 4)
    for a in range(len(fps)):
        for b in range(a):
            if bin(int(fps[a]) ^ int(fps[b])).count("1") <= 4:
                assert root[a] == root[b]
    assert len(set(root.tolist())) == len(fps) - 40


def spans(rows: list[tuple], length: int = 100) -> dict:
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    seen, out = set(), {}
    for k in order:
        raw = (rows[k][1] or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for a in range(len(raw) - length + 1):
            s = raw[a : a + length]
            if s in seen:
                gone[a : a + length] = True
            seen.add(s)
        runs = int((np.diff(np.r_[0, gone[:-1].astype(int)]) == 1).sum()) if len(raw) else 0
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out[k] = (rows[k][0], len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def span_corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    passage = [" ".join(words(rng, 40)) for _ in range(4)]
    rows = [(1, None), (2, ""), (3, "short"), (4, "x" * 350), (5, "é" * 120), (6, "ab" * 200)]
    for k in range(7, 40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(passage)
            cut = rng.randint(0, 30)
            parts.append(p[cut : cut + rng.randint(90, 200)] if rng.random() < 0.6 else " ".join(words(rng, rng.randint(5, 60))))
        rows.append((k, " ".join(parts)))
    rows += [(50, rows[10][1]), (51, rows[10][1])]
    return [(i, t, "x", 7) for i, t in rows]


@pytest.mark.parametrize(("seed", "chunk_bytes", "hot"), [(1, 2 << 20, 50_000), (2, 700, 3), (3, 1500, 1)])
def test_removed_spans(spark, seed, chunk_bytes, hot):
    rows = span_corpus(seed)
    found = suffix_dedup.dedup(spark.createDataFrame(rows, DOCS), chunk_bytes=chunk_bytes, hot=hot).collect()
    got = sorted((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
    assert got == sorted(spans(rows).values())


def test_chunk_numbers_of_partitions_do_not_meet(spark):
    """One chunk a document, thousands to a partition."""
    docs = spark.range(10_000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        chunks = suffix_dedup.lay_out(docs, "doc_id", "text", 1)
        assert chunks.select("chunk").distinct().count() == chunks.count() == 10_000
        rows = chunks.orderBy("chunk").selectExpr("ids[0] AS id").collect()
        assert [r.id for r in rows] == list(range(10_000))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.mark.parametrize("hot", [5_000, 2])
def test_rows_sent_follow_groups_of_chunks(spark, monkeypatch, tmp_path, hot):
    """Hundreds of chunks in few partitions send a row for each group and shard, however many chunks there are."""
    rng = random.Random(12)
    passage = [" ".join(words(rng, 30)) for _ in range(5)]
    rows = [(k, " ".join([*words(rng, 20), rng.choice(passage), *words(rng, 20)]), "x", 7) for k in range(400)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/docs")  # a table of known size
    made, put = {}, suffix_dedup.store
    monkeypatch.setattr(suffix_dedup, "store", lambda df, name: made.setdefault(name, put(df, name)))
    monkeypatch.setattr(suffix_dedup, "drop", lambda *frames: None)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        found = suffix_dedup.dedup(spark.read.parquet(f"{tmp_path}/docs"), chunk_bytes=600, hot=hot).collect()
        chunks, groups = made["chunks"].count(), made["chunks"].selectExpr("shiftright(chunk, 4)").distinct().count()
        sent = {name: df.count() for name, df in made.items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert sorted((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == sorted(spans(rows).values())
    assert chunks > 150 and groups < 30
    assert sent["repeated"] <= 3 * groups and sent["contexts"] <= 4 * groups and sent["sorted"] <= 3 * (groups + 3)


def test_merged_heads():
    kind = [("w", "S3"), ("chunk", "<i8"), ("at", "<i4")]
    rng = np.random.default_rng(3)
    lists = []
    for k in range(2):
        w = np.unique(rng.integers(97, 101, (30, 3), dtype=np.uint8), axis=0)
        one = np.zeros(len(w), kind)
        one["w"], one["chunk"], one["at"] = np.ascontiguousarray(w).view("S3")[:, 0], rng.integers(0, 3, len(w)), 2 * rng.integers(0, 50, len(w)) + k
        lists.append(one)
    for a, b in (lists, lists[::-1], (lists[0], lists[0][:0]), (lists[0][:0], lists[1])):
        merged, later = suffix_dedup.merge_sorted(a, b)
        every = sorted(x.tolist() for x in np.concatenate([a, b]))
        first = {x[0]: x for x in reversed(every)}
        assert [x.tolist() for x in merged] == sorted(first.values())
        assert sorted(x.tolist() for x in later) == [x for x in every if first[x[0]] != x]


def test_suffix_ranks_and_prefixes():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 3, 400).astype(np.int32)
    sa, _ = suffix_dedup.suffix_ranks(text, 50)
    keys = [text[i : i + 50].tolist() for i in sa]
    assert keys == sorted(keys)
    lcp = suffix_dedup.common_prefixes(text, sa, 50, lanes=7)
    for k in range(1, len(sa)):
        a, b = text[sa[k] :].tolist(), text[sa[k - 1] :].tolist()
        n = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert min(n, 50) == lcp[k]


def test_equal_ids_and_empty_tables(spark):
    text = "word " * 60
    rows = [(1, text, "x", 1), (1, text, "x", 1), (None, text, "x", 1)]
    found = suffix_dedup.dedup(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.n_bytes - r.n_removed for r in found)[:2] == [0, 0]  # the first of the three keeps its own first part
    none = spark.createDataFrame([], DOCS)
    assert suffix_dedup.dedup(none).count() == simhash.near_duplicates(none).count() == simhash.keep_one(none).count() == 0


def hits(docs: list[tuple], items: list[tuple], size: int = 13) -> dict:
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    out = {}
    for d, t in docs:
        ws, hit, found = low(t), set(), set()
        for i, s in items:
            its = low(s)
            for a in range(max(len(its) - size, 0) + 1 if its else 0):
                w = its[a : a + size]
                for b in range(len(ws) - len(w) + 1):
                    if ws[b : b + len(w)] == w:
                        hit |= set(range(b, b + len(w)))
                        found.add(str(i))
        out[d] = (len(ws), len(hit), sorted(found))
    return out


def leaving(docs: list[tuple], items: list[tuple], size: int = 13) -> set:
    """Ids of documents that hold a whole window of an item, or of whose words a twentieth is hit."""
    found = hits(docs, items, size)
    whole = hits(docs, [(i, s) for i, s in items if len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s or "")) >= size], size)
    return {d for d, (n, hit, _) in found.items() if whole[d][1] or hit and 20 * hit >= n}


@pytest.mark.parametrize("block_words", [500_000, 30])
def test_benchmark_hits(spark, block_words):
    rng = random.Random(5)
    items = [(k, " ".join(words(rng, rng.choice([3, 13, 20, 40])))) for k in range(10)] + [(10, None), (11, "..."), (12, "solo"), (13, "solo")]
    docs = [(0, None), (1, ""), (2, "x SOLO, y"), (3, items[2][1])]
    for k in range(4, 20):
        part = items[rng.randrange(10)][1].split()
        a = rng.randint(0, max(len(part) - 13, 0))
        docs.append((k, " ".join([*words(rng, 9), *part[a : a + 20], *words(rng, 5)])))
    rows = decontam.benchmark_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words).collect()
    assert {r.id: (r.n_words, r.n_hit, r["items"]) for r in rows} == hits(docs, items)
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_hit for r in rows)


def test_windows_of_late_terms_are_found_in_a_large_segment(spark):
    """Term numbers times the length of a segment pass 32 bits."""
    many = [f"w{k}" for k in range(60_000)]
    docs, items = [(1, " ".join(many)), (2, " ".join(many[-20:]))], [(7, " ".join(many[-13:]))]
    found = decontam.benchmark_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.id: (r.n_words, r.n_hit, r["items"]) for r in found.collect()} == {1: (60_000, 13, ["7"]), 2: (20, 13, ["7"])}


@pytest.mark.parametrize("block_words", [500_000, 30])
def test_items_without_id_are_searched_for(spark, block_words):
    named, unnamed = ([f"{c}{k}" for k in range(20)] for c in "ab")
    docs = spark.createDataFrame([(1, " ".join(named), "x", 1), (2, " ".join(["z", *unnamed]), "x", 1), (3, "clean text", "x", 1)], DOCS)
    items = spark.createDataFrame([(7, " ".join(named)), (None, " ".join(unnamed))], "item_id long, text string")
    found = {r.id: (r.n_words, r.n_hit, r["items"]) for r in decontam.benchmark_hits(docs, items, block_words=block_words).collect()}
    assert found == {1: (20, 20, ["7"]), 2: (21, 20, [None]), 3: (2, 0, [])}
    assert [r.doc_id for r in decontam.remove_contaminated(docs, items, block_words=block_words).collect()] == [3]


@pytest.mark.parametrize(("block_words", "segment_bytes"), [(500_000, 6 << 20), (30, 1), (30, 400)])
def test_a_window_in_a_long_document_turns_it_away(spark, block_words, segment_bytes):
    rng = random.Random(9)
    items = [(k, " ".join(words(rng, rng.choice([3, 15, 30])))) for k in range(12)]
    docs = []
    for k in range(60):
        part = items[rng.randrange(12)][1].split()
        body = words(rng, rng.choice([5, 60, 900]))
        docs.append((k, " ".join([*body, *part[: rng.choice([0, 3, 12, 13, 20])], *body[:4]])))
    given = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(docs)], DOCS)
    left = decontam.remove_contaminated(given, spark.createDataFrame(items, "item_id long, text string"), block_words=block_words, segment_bytes=segment_bytes)
    gone = leaving(docs, items)
    assert sorted(r.doc_id for r in left.collect()) == [k for k, _ in docs if k not in gone] and 0 < len(gone) < 60


def test_names_of_the_callers_columns_do_not_matter(spark):
    """Extra columns with the names that the operators use inside."""
    extra = ["n", "id", "key", "row", "root", "fp", "none", "copies", "alike", "times", "_key", "_row", "segment", "place", "stored", "ids", "gone", "size", "bucket", "part", "s", "h", "share", "target"]
    rng = random.Random(10)
    texts = [" ".join(words(rng, 60)) for _ in range(6)]
    rows = [(k, texts[k % 6], "abc"[k % 3], *[f"{c}{k}" for c in extra]) for k in range(12)] + [(1, texts[1], "b", *[f"{c}x" for c in extra])]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, source string", *[f"`{c}` string" for c in extra]]))
    items = spark.createDataFrame([(1, texts[2])], "item_id long, text string")
    for out, want in ((simhash.keep_one(docs), range(6)), (decontam.remove_contaminated(docs, items), [k for k in [*range(12), 1] if k % 6 != 2]), (mixing.repeat_by_copies(docs), None)):
        assert out.columns == docs.columns
        found = out.collect()
        assert want is None or sorted(r.doc_id for r in found) == sorted(want)
        assert {tuple(r) for r in found} <= set(rows)


def test_contaminated_rows_leave_and_clean_ones_stay(spark):
    item = " ".join(f"w{k}" for k in range(20))
    docs = [(1, item, "a", 1), (1, "clean text", "a", 1), (None, item, "a", 1), (2, None, "a", 1), (2, None, "a", 1)]
    left = decontam.remove_contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == [(1, "clean text"), (2, None), (2, None)]
    assert left.columns == ["doc_id", "text", "fp", "id"]


def test_proximity():
    seg = decontam.Segment.build([b"a x b y c".split(), b"a q q q b c".split()])
    assert decontam.proximity_matches(seg, [b"a", b"b", b"c"], 4).tolist() == [0]
    assert decontam.proximity_matches(seg, [b"a", b"b", b"c"], 3).tolist() == []
    assert len(decontam.proximity_matches(seg, [b"a", b"zzz"], 3)) == 0


@pytest.mark.parametrize("segment_bytes", [6 << 20, 1])
def test_proximity_over_the_stored_index(spark, segment_bytes):
    rng = random.Random(6)
    docs = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30)))) for k in range(40)] + [(None, "C, a. x B"), (41, None), (42, "a c"), (43, "b a")]
    want = []
    for i, t in docs:
        ws = (t or "").lower().replace(",", "").replace(".", "").split()
        near = [p for p, w in enumerate(ws) if w in "abc" and all(o in ws[p : p + 3] for o in "abc")]
        want += [(i, near)] if near else []
    index = decontam.build_index(spark.createDataFrame(docs, "doc_id long, text string"), segment_bytes=segment_bytes)
    found = decontam.search_near(index, "A b, c", 2).collect()
    assert sorted(((r.id, r.positions) for r in found), key=str) == sorted(want, key=str) and want
    assert decontam.search_near(index, "a zzz", 2).count() == decontam.search_near(index, "", 2).count() == 0


def test_an_indexing_worker_holds_numbers_and_no_encoder():
    """A segment's words are not held one by one, and what an earlier stage's encoder keeps in the worker is dropped first."""
    import sys
    import tracemalloc

    import pyarrow as pa

    from corvane.llm.encoding import encoder
    from corvane.llm.queries import vocabulary

    encoder(vocabulary()).encode(["some words"])
    texts = [" ".join(f"w{(k * 37 + j) % 5000}" for j in range(1000)) for k in range(300)]
    rows = pa.StructArray.from_arrays([pa.array(range(300)), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    found = list(decontam.index_rows([pa.record_batch([rows], names=["row"])], (0, 1), 1 << 30, True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 14_000_000  # the words alone, as bytes in lists, are 300,000 times 46 bytes at least
    assert not vars(sys.modules["tokenizers"]).get("_corvane_encoders")
    seg, want = decontam.segment_of(found[0], 0), decontam.Segment.build([decontam.words_of(t.encode()) for t in texts])
    assert len(found) == 1 and seg.terms == want.terms and (seg.positions == want.positions).all() and (seg.lengths == want.lengths).all()
    assert [r for part in decontam.from_stream(found[0].column("stored")[0].as_py()) for r in part.field(1).to_pylist()] == texts
