from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.operators import assemble, chunking, convert, evals, fusion, lifecycle, retrieve, traces
from corvane.sources import readers

HITS = "qid int, id string, score double, rank int"


def hits(spark, *names):
    return spark.createDataFrame([(1, n, 1.0 - k / 10, k + 1) for k, n in enumerate(names)], HITS)


def order(df):
    return [r.id for r in df.orderBy("qid", "rank").collect()]


def test_dense_topk_skips_rows_without_vectors(spark, monkeypatch):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "qid int, qvec array<double>")
    p = spark.createDataFrame([(1, [1.0, 0.1]), (2, None), (3, [0.0, 1.0]), (4, [2.0, 0.2])], "id int, vec array<double>")
    want = [(1, 1), (1, 4), (1, 3), (2, 1), (2, 3), (2, 4)]
    assert [(r.qid, r.id) for r in retrieve.dense_topk(q, p, 3).orderBy("qid", "rank").collect()] == want
    monkeypatch.setattr(retrieve, "BLOCK_NUMBERS", 1)
    monkeypatch.setattr(retrieve, "BATCH_SCORES", 1)
    assert [(r.qid, r.id) for r in retrieve.dense_topk(q, p, 3).orderBy("qid", "rank").collect()] == want


def test_ann_recall(spark):
    pts = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = pts.filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    exact = {(r.qid, r.id) for r in retrieve.dense_topk(q, pts, 10).collect()}
    near = {(r.qid, r.id) for r in retrieve.ann_topk(q, pts, 10, probes=12).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_registered_ann_query(spark, sf):
    from corvane import catalog

    d = f"/root/testdata/{sf}"
    pts = catalog.dense_points(spark, d)
    q = pts.filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    exact = {(r.qid, r.id) for r in retrieve.dense_topk(q, pts, 10).collect()}
    near = {(r.qid, r.id) for r in catalog.ret03_ann_topk(spark, d).collect()}
    assert len(near) == len(exact) and len(exact & near) >= 0.9 * len(exact)


def test_ann_sample_is_drawn_from_the_whole_table(spark):
    pts = spark.range(0, 4000, 1, 4).select("id", F.array(F.floor(F.col("id") / 1000).cast("double") + 1, F.lit(1.0)).alias("vec"))
    x = retrieve.ann_sample(pts, 400)
    assert 300 < len(x) < 500 and len({round(v, 6) for v in x[:, 0]}) == 4


def test_demo_tokens(spark):
    r = spark.createDataFrame([("Paid bills: payments, cats is x9s",)], "t string").select(retrieve.demo_tokens(F.col("t")).alias("t")).first()
    assert r.t == ["pay", "invoice", "pay", "cat", "is", "x9s"]


def test_rrf_ties_go_to_the_first_channel(spark):
    assert order(fusion.rrf([hits(spark, "b"), hits(spark, "a")], 5)) == ["b", "a"]
    assert order(fusion.rrf([hits(spark, "a", "b", "b"), hits(spark, "b")], 5)) == ["b", "a"]
    with pytest.raises(ValueError):
        fusion.rrf([hits(spark, "a")], 1, weights=(1, 2))


def test_dbsf_without_spread(spark):
    assert [r.score for r in fusion.dbsf([hits(spark, "a")], 5).collect()] == [0.5]


def test_merges(spark):
    v, s = hits(spark, "a", "b", "c"), hits(spark, "c", "x")
    assert order(fusion.merge_prefer_sidecar(v, s, 10)) == ["c", "x", "a", "b"]
    assert order(fusion.merge_max(v, s, 10)) == ["a", "c", "b", "x"]
    assert order(fusion.merge_blend(v, s, 10, 0.5)) == ["c", "x", "a", "b"]
    assert order(fusion.admit_sidecar(s, v, 3)) == ["c", "x"]


def test_rerank_keeps_order_of_a_failed_provider(spark):
    h = hits(spark, "a", "b", "c")
    none = spark.createDataFrame([], "qid int, id string, rerank_score double, rerank_rank int")
    assert order(fusion.apply_rerank(h, none, 2)) == ["a", "b", "c"]
    some = spark.createDataFrame([(1, "b", 9.0, 1)], none.schema)
    assert order(fusion.apply_rerank(h, some, 2)) == ["b", "a", "c"]


def test_mmr_prefers_what_is_different(spark):
    c = spark.createDataFrame([(1, "a", 1.0, 1, [1.0, 0.0]), (1, "b", 0.99, 2, [1.0, 0.0]), (1, "c", 0.5, 3, [0.0, 1.0])], HITS + ", vec array<double>")
    assert order(fusion.mmr(c, 0.6, 2)) == ["a", "c"]


def test_neighbors_are_claimed_once(spark):
    h = spark.createDataFrame([(1, "d", 2, 1), (1, "d", 3, 2)], "qid int, document_id string, chunk_index int, rank int")
    c = spark.createDataFrame([("d", k, f"t{k}") for k in range(6)], "document_id string, chunk_index int, text string")
    r = {x["rank"]: x for x in assemble.expand_neighbors(h, c, 1, 5).collect()}
    assert [n.chunk_index for n in r[1].before] == [1] and [n.chunk_index for n in r[1].after] == [3]
    assert r[2].before == [] and [n.chunk_index for n in r[2].after] == [4]


def test_collapse(spark):
    h = spark.createDataFrame([(1, "a", "t", "same", 0.1, 1), (1, "b", "t", "same", 0.9, 3), (1, "c", "t", "other", 0.5, 2)], "qid int, id string, kind string, text string, score double, rank int")
    r = assemble.collapse_equal(h).orderBy("rank").collect()
    assert [(x.id, x.equivalents) for x in r] == [("b", ["a"]), ("c", [])]


def test_packing_frees_stripped_characters(spark):
    rows = [(1, 1, "k1", "[a]", "x" * 5 + " " * 20 + "y"), (1, 2, "k1", "[a]", "again"), (1, 3, "k2", "[b]", "short")]
    h = spark.createDataFrame(rows, "qid int, rank int, dedupe_key string, header string, text string")
    r = assemble.pack_context(h, 5, 24).first()
    assert [(s.header, s.text, s.truncated) for s in r.snippets] == [("[a]", "xxxxx", True), ("[b]", "short", False)]
    assert (r.dropped, r.truncated, r.char_count) == (1, True, 9 + 2 + 9)
    assert assemble.pack_context(h, 1, None).first().dropped == 2


def test_packing_strips_the_stated_white_space(spark):
    h = spark.createDataFrame([(1, 1, "k1", "[a]", "xxxxx\n  y" + "z" * 20)], "qid int, rank int, dedupe_key string, header string, text string")
    assert [s.text for s in assemble.pack_context(h, 5, 12).first().snippets] == ["xxxxx"]
    assert [s.text for s in assemble.pack_context(h, 5, 12, space=" ").first().snippets] == ["xxxxx\n"]


def test_packing_query_keeps_a_line_end_at_the_cut_as_its_sql_does(spark, tmp_path):
    import duckdb

    from corvane import catalog

    rows = [(1, 0, "user", "a" * 590 + "\n" + "b" * 50), (1, 1, "user", "more"), (2, 0, "user", "c" * 590 + "\u3000" + "d" * 50)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(catalog.ORACLES["ctx03_pack_context"]).fetchall()
    assert sorted(map(tuple, catalog.ctx03_pack_context(spark, str(tmp_path)).collect())) == sorted(want)
    assert {w[0]: w[4] for w in want} == {1: 600, 2: 599}


def test_expanded_text(spark):
    f = lambda b, t, a, n: spark.range(1).select(assemble.expanded_text(F.lit(b), F.lit(t), F.lit(a), F.lit(n)).alias("r")).first().r
    assert f("before", "body", "after", 100) == "before\n\nbody\n\nafter"
    assert f("before", "body", "after", 12) == "re\n\nbody\n\naf"
    assert f("before", "body", None, 8) == "re\n\nbody" and f("b", "body text", "a", 5) == "body"


def test_lifecycle(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], "id string, v int, n int")
    assert sorted(map(tuple, lifecycle.upsert(old, new, "id", "n").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    lines = spark.createDataFrame([(1, "d1", "k"), (2, "d2", "k"), (3, "d3", "x")], "line_no int, document_id string, document_key string")
    assert sorted(r.document_id for r in lifecycle.compact_manifest(lines).collect()) == ["d2", "d3"]
    e = spark.createDataFrame([("k", "d", None)], "document_key string, document_id string, content_sha256 string")
    s = spark.createDataFrame([("k", "h")], "document_key string, content_sha256 string")
    assert lifecycle.reconcile(e, s).first().reason == "present_without_hash_check"


def test_swaps(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    lifecycle.swap_in(spark.range(3), path)
    lifecycle.swap_in(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    (tmp_path / "t").rename(tmp_path / "t.old")
    lifecycle.recover_swap(spark, path)
    assert spark.read.parquet(path).count() == 5


def test_metrics(spark):
    h = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (1, "a", 3), (1, "b", 4)], "case_id int, doc_id string, rank int")
    g = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "z", 1)], "case_id int, doc_id string, grade int")
    r = {x.case_id: x for x in evals.case_metrics(h, g, 3).collect()}
    assert (r[1].recall, r[1].reciprocal_rank) == (0.5, 0.5) and (r[2].recall, r[2].ndcg) == (0.0, 0.0)
    assert abs(r[1].ndcg - (3 / 1.584962501) / (3 + 1 / 1.584962501)) < 1e-6


def test_trace_errors(spark):
    cols = "search_id string, seq int, event_type string, stage string, succeeded boolean, attempted_rerank boolean, applied_rerank boolean, error_type string, duration_ms double, result_count int"
    rows = [("s", 1, "stage.error", "search", None, None, None, "E", None, None), ("s", 2, "stage.error", "rerank", None, True, None, "F", None, None), ("s", 3, "search.completed", None, True, None, None, None, 5.0, 2)]
    r = traces.search_summary(spark.createDataFrame(rows, cols)).first()
    assert [e.stage for e in r.errors] == ["rerank"] and r.attempted_rerank and r.completed and r.result_count == 2


@pytest.mark.parametrize("strategy", list(chunking.STRATEGIES))
def test_chunks_are_slices(spark, strategy):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    cfg = chunking.Config(400, 50)
    made = chunking.chunk(docs, strategy, cfg, "doc_id").join(docs.select(F.col("doc_id").alias("document_id"), F.col("text").alias("full")), "document_id").collect()
    assert made and all(r.text == r.full[r.start_char : r.end_char] and chunking.fits(r.text, cfg) for r in made)


def test_sections_and_fences():
    body = "intro\n\n# A\ntext\n```\n# not\n```\n## B ##\nmore\n# C"
    assert [t for _, _, t in chunking.markdown_sections(body)] == [[], ["A"], ["A", "B"], ["C"]]


def test_long_words_are_split():
    cfg = chunking.Config(100, 10)
    cut = chunking.markdown_chunks("x" * 450, cfg)
    assert all(c["end_char"] - c["start_char"] <= 100 for c in cut) and cut[-1]["end_char"] == 450


@pytest.mark.parametrize(("raw", "want"), [(b"\xef\xbb\xbfhi", "hi"), ("hé".encode("utf-16"), "hé"), ("hé".encode("cp1252"), "hé"), ("wide text".encode("utf-16-le"), "wide text"), (b"", "")])
def test_decoding(raw, want):
    assert convert.decode(raw) == want


def test_binary_content_is_refused():
    with pytest.raises(ValueError):
        convert.decode(b"abc\x00\x01\x02\x03" * 3)


def test_converters(spark):
    assert convert.plain_to_markdown("INTRO HERE\n• one\n2) two\n\n\nBody text.") == "## Intro Here\n- one\n2) two\n\nBody text."
    assert convert.from_csv("a;b\n1;2\n3;4|5")[0].split("\n")[0] == "| a | b |"
    assert convert.from_json('{"a":1}')[0] == '```json\n{\n  "a": 1\n}\n```' and convert.from_json("{")[1] == {"parse_error": True}
    assert convert.from_xml("<a><b>1</b></a>")[1] == {} and convert.from_xml("<!DOCTYPE a><a/>")[1]["parse_error"]
    assert convert.from_html("<nav>x</nav><h1>T</h1><p>a &amp; b</p><ul><li>c</ul>")[0] == "# T\n\na & b\n\n- c"
    files = spark.createDataFrame([("1", "a.md", "text/plain", b"# T\n\nwords " * 9), ("2", "a.doc", None, b"x"), ("3", "b.bin", None, b"\x00" * 9), ("4", "p.pdf", None, b"%PDF")], "document_id string, name string, mime string, content binary")
    r = {x.document_id: x for x in convert.convert(files).collect()}
    assert r["1"].error is None and r["1"].quality.verdict == "good" and r["2"].format is None and "binary" in r["3"].error and "not installed" in r["4"].error


def _zip(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, body in files.items():
            z.writestr(n, body)
    return out.getvalue()


def test_office_files():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    docx = _zip({"word/document.xml": f"<w:document {w}><w:body>{p('T', 'Heading1')}{p('i', 'ListBullet')}<w:tbl><w:tr><w:tc>{p('c')}</w:tc></w:tr></w:tbl></w:body></w:document>"})
    assert convert.from_docx(docx)[0] == "# T\n\n- i\n\n| c |\n| --- |"
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    xlsx = _zip({"xl/workbook.xml": f'<workbook {m}><sheets><sheet name="S"/></sheets></workbook>', "xl/worksheets/sheet1.xml": f"<worksheet {m}><sheetData><row><c><v>1</v></c><c><v>2</v></c></row><row><c><v>3</v></c></row></sheetData></worksheet>"})
    assert "## S" in convert.from_xlsx(xlsx)[0] and "| 3 |" in convert.from_xlsx(xlsx)[0]
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    assert convert.from_pptx(_zip({"ppt/slides/slide1.xml": f"<s {a}><a:p><a:r><a:t>Hi</a:t></a:r></a:p></s>"}))[0] == "## Slide 1\n\n### Hi"


def test_archives(spark):
    rows = [("ok", _zip({"a.txt": "1", "d/b.txt": "2"})), ("bad", _zip({"../x": "1"})), ("none", b"no zip")]
    r = readers.zip_members(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert sorted(x.member for x in r if x.path == "ok") == ["a.txt", "d/b.txt"] and sum(x.error is not None for x in r) == 2


def test_files_and_lines(spark, tmp_path):
    for n in ("a.md", "b.exe", "~$c.docx", "sub/d.txt"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text("x")
    assert sorted(r.name for r in readers.files(spark, str(tmp_path)).collect()) == ["a.md", "d.txt"]
    found, left = readers.local_paths(str(tmp_path), 1)
    assert len(found) == 1 and left["truncated"] == 1 and left["unsupported"] == 1
    (tmp_path / "m.jsonl").write_text('{"document_id":"d","chunk_count":1}\n\n{"document_id":"d","chunk_count":2}\n')
    assert [r.chunk_count for r in readers.manifest(spark, f"{tmp_path}/m.jsonl").collect()] == [2]
    (tmp_path / "c.jsonl").write_text('{"query":"q","expected_ids":["a"]}\n{"query":"r","expected_ids":[],"expect_no_results":true}\n')
    assert readers.cases(spark, f"{tmp_path}/c.jsonl").count() == 2
    (tmp_path / "c2.jsonl").write_text('{"query":"q","expected_ids":[]}\n')
    with pytest.raises(ValueError):
        readers.cases(spark, f"{tmp_path}/c2.jsonl")
    (tmp_path / "u.txt").write_text("# c\nhttps://e.com/a#1\nhttps://e.com/a#2\n")
    with pytest.raises(ValueError):
        readers.url_list(spark, f"{tmp_path}/u.txt")


def test_batches_that_are_refused_are_halved():
    from corvane.operators.indexing import send_in_halves

    sent, tried = [], []

    def send(rows):
        tried.append(len(rows))
        if len(rows) > 8:
            raise TimeoutError
        sent.extend(rows)

    send_in_halves(list(range(64)), send)
    assert sent == list(range(64)) and max(tried) == 64
    with pytest.raises(TimeoutError):
        send_in_halves(list(range(256)), lambda rows: (_ for _ in ()).throw(TimeoutError()))
    with pytest.raises(ValueError):
        send_in_halves([1, 2], lambda rows: (_ for _ in ()).throw(ValueError()))


def test_dimensions_and_segments():
    from corvane.operators.indexing import check_segment, resolve_dimensions

    known = {("p", "m"): {"default": 8, "allowed": [4, 8]}, ("p", "f"): {"default": 8, "fixed": True}, ("p", "x"): {"default": 8, "most": 16}}
    assert [resolve_dimensions(known, *a) for a in ((" P", "m", None), ("p", "m", 4), ("p", "f", 8), ("p", "x", 3), ("q", "z", 5))] == [8, 4, 8, 3, 5]
    for a in (("q", "z", None), ("p", "m", 5), ("p", "f", 4), ("p", "x", 17), ("p", "m", True), ("p", "m", 0)):
        with pytest.raises(ValueError):
            resolve_dimensions(known, *a)
    assert check_segment("collection", "a-b") == "a-b"
    for bad in ("", " a", "..", "a/b", "A", "a\\b"):
        with pytest.raises(ValueError):
            check_segment("collection", bad)


def test_wrong_payloads_are_refused(spark):
    from corvane.operators import payloads

    with pytest.raises(Exception, match="no text"):
        payloads.result_rows(spark.createDataFrame([(1, '{"text":5,"content_type":"x"}', 0.5)], "id int, payload string, score double")).collect()


@pytest.mark.parametrize(("text", "want"), [
    ("A TITLE\n\n\n\n• one\n2) two", "## A Title\n\n- one\n2) two"), ("Short Title\nends here.\n    code\n", "## Short Title\nends here.\n    code\n"), ("ABC\nIt\n- ", "ABC\n## It\n-"), ("\n\nx", "x"),
])
def test_plain_text(text, want):
    from corvane.operators.convert import plain_to_markdown

    assert plain_to_markdown(text) == want


def test_planned_members_tell_changes(spark):
    def packed(**members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in members.items():
                z.writestr(f"{name}.txt", body)
        return bytearray(out.getvalue())

    plan = readers.zip_members(spark.createDataFrame([("a", packed(x="1", y="2", z="3")), ("b", packed(x="1"))], "path string, content binary")).select("path", "member", "content_sha256")
    later = spark.createDataFrame([("a", packed(x="1", y="9")), ("b", bytearray(b"no archive"))], "path string, content binary")
    got = {(r.path, r.member): (r.content and bytes(r.content), r.error) for r in readers.planned_members(later, plan).collect()}
    assert got["a", "x.txt"] == (b"1", None) and got["a", "y.txt"] == (None, "member changed after planning") and got["a", "z.txt"] == (None, "member not found")
    assert got["b", "x.txt"][0] is None and "BadZipFile" in got["b", "x.txt"][1]


def test_urls_are_read_within_bounds(spark):
    from corvane.sources.remote import FetchPolicy, fetched

    def lookup(host):
        return {"inside.example.com": ["10.0.0.7"], "both.example.com": ["93.184.216.34", "127.0.0.1"], "six.example.com": ["::ffff:192.168.0.1"]}.get(host, ["93.184.216.34"])

    def opener(url, address, seconds, most):
        path = url.split("/", 3)[3]
        if path == "loop":
            return 302, {"location": "/loop"}, b""
        if path == "in":
            return 301, {"location": "https://inside.example.com/"}, b""
        return (404, {}, b"") if path == "gone" else (200, {"content-type": "Text/HTML; charset=x"}, b"x" * (20 if path == "large" else 3))

    names = ["https://a.example.com/ok", "http://a.example.com/ok", "https://u:p@a.example.com/ok", "https://inside.example.com/ok", "https://both.example.com/ok", "https://six.example.com/ok", "https://a.example.com/loop", "https://a.example.com/in", "https://a.example.com/gone", "https://a.example.com/large", "https://other.org/ok"]
    rows = fetched(spark.createDataFrame([(n,) for n in names], "url string"), FetchPolicy(hosts=("*.example.com",), most_bytes=10), opener, lookup).collect()
    assert [r.url for r in rows if r.error is None] == names[:1]
    assert bytes(rows[0].content) == b"xxx" and rows[0].mime == "text/html" and all(r.error.startswith("ValueError") for r in rows[1:])


def test_sinks(spark, tmp_path, caplog):
    from collections import deque

    from corvane.streaming import sinks

    events = spark.createDataFrame([("a", "secret", 1), ("b", "secret", 2)], "event_type string, query string, n int")
    held, path = deque(maxlen=5), f"file://{tmp_path}/e"
    caplog.set_level("INFO", "corvane.events")

    def broken(rows, number):
        raise OSError("no")

    with pytest.raises(OSError):
        sinks.several(sinks.nothing, broken, sinks.json_lines(path), sinks.buffered(held), sinks.logged())(events, 3)
    sinks.json_lines(path)(events, 3)  # again: the batch replaces its own lines
    lines = sorted(r.value for r in spark.read.text(path).select("value").collect())
    assert lines == sorted(held) == ['{"event_type":"a","n":1}', '{"event_type":"b","n":2}'] and "secret" not in caplog.text and '"n":2' in caplog.text
    with pytest.raises(ValueError):
        sinks.buffered(deque())


def test_best_keeps_k_rows_of_a_query_however_many_are_added():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    best, rows = retrieve.Best(5, 3, once=True), {}
    for _ in range(6):
        n, score, ids = rng.integers(0, 4, 100_000), rng.integers(0, 200, 100_000) / 10, rng.integers(0, 3000, 100_000)
        best.add(n, score, pa.array(ids))
        for key, v in zip(zip(n.tolist(), ids.tolist(), strict=True), score.tolist(), strict=True):
            rows[key] = max(v, rows.get(key, -1.0))
    want = [(n, *x) for n in range(4) for x in sorted((-v, i) for (m, i), v in rows.items() if m == n)[:3]]
    found = pa.Table.from_batches(best.rows())
    assert [(r["n"], -r["score"], r["id"]) for r in found.to_pylist()] == want
    assert best.floor[4] == -np.inf and best._rows == 12


def test_sidecar_answers_equal_queries_once(spark, monkeypatch):
    from corvane.operators import lexical

    asked = []
    monkeypatch.setattr(lexical, "query_blocks", lambda rows, most: [asked.append(rows.collect()) or asked[-1]])
    q = spark.createDataFrame([(n, "Red  ring" if n % 2 else "blue bolt") for n in range(40)] + [(99, " ")], "qid int, query string")
    r = spark.createDataFrame([(f"r{n % 70:02d}", ("red ring", "a blue bolt", "red rings", None)[n % 4], "red ring" if n % 10 == 2 else None) for n in range(140)], "id string, title string, text string")
    found = lexical.sidecar_topk(q, r, 3).orderBy("qid", "rank").collect()
    assert [x.needle for x in asked[0]] == ["blue bolt", "red ring"]
    assert {x.qid for x in found} == set(range(40))
    assert [(x.id, x.score, x.field, x.strategy) for x in found if x.qid == 1] == [("r00", 1.0, "title", "exact"), ("r02", 1.0, "title", "exact"), ("r04", 1.0, "title", "exact")]
    assert [(x.id, x.score, x.strategy, x["rank"]) for x in found if x.qid == 2] == [("r01", 0.9, "exact", 1), ("r03", 0.9, "exact", 2), ("r05", 0.9, "exact", 3)]


def test_dense_topk_sends_k_rows_of_a_query_from_a_task_and_keeps_repeated_ids(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieve, "BATCH_SCORES", 64)
    sent = []
    ranked = retrieve.ranked
    monkeypatch.setattr(retrieve, "ranked", lambda rows, *a: sent.append(rows.count()) or ranked(rows, *a))
    x = np.random.default_rng(2).normal(size=(400, 4))
    p = spark.createDataFrame([(n // 2, [float(v) for v in r]) for n, r in enumerate(x)], "id int, vec array<double>").coalesce(1)
    q = spark.createDataFrame([(n, [float(v) for v in x[n]]) for n in range(8)], "qid int, qvec array<double>")
    found = retrieve.dense_topk(q, p, 5).collect()
    assert sent == [8 * 5]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {n: [i for _, i in sorted((-round(float(s), 6), k // 2) for k, s in enumerate(unit @ unit[n]))[:5]] for n in range(8)}
    assert {n: [r.id for r in sorted((r for r in found if r.qid == n), key=lambda r: r["rank"])] for n in range(8)} == want


def test_sparse_scores_are_made_in_bounded_pieces():
    import numpy as np

    rng = np.random.default_rng(3)
    dense = rng.integers(-2, 3, (40, 6)).astype(float)  # queries by terms
    qid, term = np.nonzero(dense)
    index = retrieve.Terms([f"q{x:02d}" for x in qid], term.tolist(), dense[qid, term].tolist())
    points = rng.integers(0, 4, (50, 9)).astype(float)
    row, col = np.nonzero(points)
    at, use = index.find(col)
    for products in (1, 7, 100, 1 << 20):
        pieces = list(index.scores(at[use], points[row, col][use], row[use], 50, products))
        assert max(s.size for _, s in pieces) <= max(products, 40)
        assert np.array_equal(np.concatenate([s for _, s in pieces]), points[:, :6] @ dense.T)


def test_sparse_topk_keeps_negative_scores_and_drops_zeros(spark):
    q = spark.createDataFrame([(1, 5, 1.0), (1, 7, 1.0), (2, 7, -2.0), (3, 9, 1.0)], "qid int, idx int, val double")
    p = spark.createDataFrame([("a", 5, 1.0), ("a", 7, -1.0), ("b", 7, 2.0), ("c", 5, 3.0), ("c", 8, 9.0), ("d", 5, 1e-9)], "id string, idx int, val double")
    found = [(r.qid, r.id, r.score) for r in retrieve.sparse_topk(q, p, 2).orderBy("qid", "rank").collect()]
    assert found == [(1, "c", 3.0), (1, "b", 2.0), (2, "a", 2.0), (2, "b", -4.0)]


def test_chunks_are_handed_on_in_bounded_pieces(spark, monkeypatch):
    import pyarrow as pa

    taken = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, run, schema: taken.append(run))
    chunking.chunk(spark.createDataFrame([(1, "x")], "document_id long, text string"), "semantic_heuristic")
    body = "One sentence of words. " * 300
    batch = pa.record_batch([pa.array(range(2000)), pa.array([body] * 2000)], names=["document_id", "text"])
    pieces = list(taken[0](iter([batch])))
    assert max(p.nbytes for p in pieces) < 3 * chunking.OUT_CHARS < batch.nbytes
    found = pa.Table.from_batches(pieces).to_pylist()
    assert [r["document_id"] for r in found] == sorted(r["document_id"] for r in found) and {r["document_id"] for r in found} == set(range(2000))
    assert all(r["text"] == body[r["start_char"] : r["end_char"]] for r in found)
    assert len({tuple(r["chunk_index"] for r in found if r["document_id"] == n) for n in (0, 777, 1999)}) == 1


def test_demo_counts_shuffle_keys_only_unless_they_repeat(spark):
    rows = [(1, "Paid bills: payments, cats is x9s"), (2, None), (3, "..."), (None, "cats")]
    t = spark.createDataFrame(rows, "id int, text string")
    counts, vectors = retrieve.demo_sparse(t, "id", "text"), retrieve.demo_dense(t, "id", "text")
    assert "Exchange" not in counts._jdf.queryExecution().toString() and "Exchange" not in vectors._jdf.queryExecution().toString()
    assert sorted(r.val for r in counts.collect() if r.id == 1) == [1.0, 1.0, 1.0, 1.0, 2.0]
    assert {r.id: round(sum(x * x for x in r.vec), 9) for r in vectors.collect()} == {1: 1.0, 2: 0.0, 3: 0.0, None: 0.0}
    twice = spark.createDataFrame([*rows, (1, "cats and bills")], "id int, text string")
    whole = spark.createDataFrame([(1, "Paid bills: payments, cats is x9s cats and bills")], "id int, text string")
    of = lambda f, x: sorted(map(tuple, f(x, "id", "text").filter("id = 1").collect()))
    assert of(retrieve.demo_sparse, twice) == of(retrieve.demo_sparse, whole)
    assert of(retrieve.demo_dense, twice) == of(retrieve.demo_dense, whole) * 2


def test_bm25_reads_documents_without_a_shuffle_of_postings(spark):
    rows = [(n, ["a"] * (n % 4) + ["b"] * (n % 3) + ["x" * 50, None]) for n in range(60)] + [(60, None), (61, [])]
    docs = spark.createDataFrame(rows, "id int, terms array<string>")
    q = spark.createDataFrame([("one", ["a", "b", "a"]), ("two", ["b", "none"]), ("three", None)], "qid string, terms array<string>")
    asked = q.select("qid", F.explode(F.array_distinct("terms")).alias("term"))
    want = retrieve._bm25_by_postings(asked, docs, 7, 1.2, 0.75, 6, True)
    found = retrieve.bm25_topk(q, docs, 7)
    assert "MapInArrow" in found._jdf.queryExecution().toString() and "Join" not in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and want.count() == 14
    twice = docs.union(docs.filter("id = 5"))  # rows of an id count together
    again = retrieve.bm25_topk(q, twice, 7).collect()
    assert len({(r.qid, r.id) for r in again}) == len(again) == 14


def test_delimiter_counts_only_what_the_text_has(spark):
    texts = ["a,b\nc,d", "a;b,c\nd;e\nf;g", "x|y\n" * 30, "a\tb\nc\td", "no delimiter\nat all", "one,line", "", None]
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    assert [r.d for r in t.select(convert.delimiter_of(F.col("t")).alias("d")).collect()] == [",", ";", "|", "\t", ",", ",", ",", ","]
    scores = [r.s for r in t.select(convert.delimiter_score(F.col("t"), ",").alias("s")).collect()]
    assert scores[0] == 2.0 and scores[2:] == [None] * 6
    plan = t.select(convert.delimiter_of(F.col("t")).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1  # the text is cut into lines once, lines are not cut at all


def test_reading_order_sorts_in_as_many_tasks_as_there_are_rows_for(spark, monkeypatch):
    b = spark.range(0, 600).select((F.col("id") % 40).alias("document_id"), F.lit(1).alias("page"), (F.col("id") % 2 * 320 + 10).alias("x0"), F.lit(600.0).alias("page_width"), (F.col("id") * 7 % 100 + F.col("id") / 1000).alias("y0"), F.col("id").alias("n"))
    b = b.withColumn("x1", F.col("x0") + 250)
    want = sorted(map(tuple, convert.reading_order(b).select("n", "position").collect()))
    monkeypatch.setattr(convert, "ROWS_OF_A_TASK", 60)
    found = convert.reading_order(b)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and ", 10), REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, found.select("n", "position").collect())) == want
