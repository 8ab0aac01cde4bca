"""Language identification, language model scoring, page extraction."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import html_extract, langid, lm_score, recurrent
from corvane.llm.queries import queries
from corvane.llm.tables import table

SF = "/root/testdata/sf0.01"


def test_languages_held_out(spark):
    docs = table(spark, SF, "documents")
    model = langid.train(docs.filter(langid.fold_of(F.col("doc_id")) != 0))
    found = langid.identify(docs, model).join(docs.select(F.col("doc_id").alias("id"), "lang", "text"), "id").filter((langid.fold_of(F.col("id")) == 0) & F.col("lang").isNotNull()).collect()
    sure = [r for r in found if len((r.text or "").split()) >= 20]
    assert sum(r.lang == r.lang_pred for r in sure) / len(sure) > 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_language_spans_and_odd_texts(spark):
    rows = [("the house and the tree " * 30, "en"), ("das haus und der baum " * 30, "de"), ("дом и дерево " * 30, "ru"), (None, "en"), ("x", None)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    mixed = "the house and the tree das haus und der baum дом и дерево"
    docs = spark.createDataFrame([(1, mixed), (2, None), (3, ""), (4, "12 34 !"), (5, "ДЕРЕВО"), (6, "の")], "doc_id long, text string")
    found = {r.id: r for r in langid.identify(docs, model).collect()}
    assert [s.lang for s in found[1].spans] == ["en", "de", "ru"] and sum(s.words for s in found[1].spans) == 13
    assert [found[k].lang_pred for k in (2, 3, 4)] == ["und"] * 3 and found[2].score == 0
    assert found[5].lang_pred == "ru" and found[6].lang_pred in model["codes"]
    assert langid.identify(docs.limit(0), model).count() == 0
    empty = langid.train(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5):
        s = rng.normal(size=(n, 3)).astype(np.float32) * 3
        best, want = -1e9, None
        for code in range(3**n):
            path = [code // 3**k % 3 for k in range(n)]
            v = sum(float(s[k, p]) for k, p in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:], strict=False))
            if v > best:
                best, want = v, path
        assert langid.viterbi(s, np.array([n]), 1.5).tolist() == want


def toy_docs(n: int, seed: int) -> list[str]:
    """Two dialects with no word in common: what comes next depends on what came before."""
    rng = random.Random(seed)
    return [" ".join(rng.choice("a b c d e f g h".split() if k % 2 else "p q r s t u v w".split()) for _ in range(rng.randint(5, 60))) for k in range(n)]


def test_model_is_a_distribution_and_learns():
    counts = np.array([10, 3, *range(60, 0, -2)], float)
    m = recurrent.GatedModel.start(counts, 6, 5, 0)
    states = np.random.default_rng(1).normal(size=(4, 6)).astype(np.float32)
    total = sum(np.exp(m.softmax(states, np.full(4, w), False)[0]) for w in range(len(counts)))
    assert np.allclose(total, 1, atol=1e-4)
    rng = np.random.default_rng(3)
    docs = [np.r_[rng.integers(2, 10, 30) + 10 * (k % 2), 0] for k in range(200)]
    before = m.score(docs).sum()
    for _ in range(4):
        m.learn(docs, 0.1, lanes=16, window=8)
    assert m.score(docs).sum() > 0.8 * before  # both are negative


def test_state_is_carried_across_windows():
    counts = np.full(30, 5.0)
    m = recurrent.GatedModel.start(counts, 5, 4, 2)
    m.p["U"] *= 8
    rng = np.random.default_rng(5)
    docs = [np.r_[rng.integers(1, 30, n), 0] for n in (1, 700, 3, 90, 0, 41)]
    whole = m.score(docs, lanes=1, tokens=100_000)
    assert np.allclose(whole, m.score(docs, lanes=3, tokens=7), atol=1e-3)
    assert np.allclose(whole, [m.score([d])[0] for d in docs], atol=1e-3)


def test_gradients():
    counts = np.array([4.0, 3, 9, 8, 7, 6, 5, 4])
    docs = [np.array([2, 3, 4, 0, 5, 6, 0]), np.array([7, 2, 0])]
    for name in ("X", "U", "C", "O"):
        m = recurrent.GatedModel.start(counts, 3, 3, 1)
        m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
        grads = {}
        m.step = lambda n, g, rate, rows=slice(None), grads=grads: grads.setdefault(n, []).append((rows, g.copy()))
        m.learn(docs, 0.1, lanes=2, window=100)
        full = np.zeros_like(m.p[name])
        for rows, g in grads[name]:
            full[rows] += g
        at = np.unravel_index(np.abs(full).argmax(), full.shape)
        loss = lambda m=m: -m.score(docs).sum() / sum(map(len, docs))
        m.p[name][at] += 1e-3
        up = loss()
        m.p[name][at] -= 2e-3
        assert abs((up - loss()) / 2e-3 - full[at]) < 0.05 * abs(full[at]) + 1e-4


def test_scores(spark):
    texts = [*toy_docs(120, 1), None, "", "  ", "NEW words A", "p " * 4000]
    rows = [(k, t, k % 5 != 1, 0.5) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean, score double").repartition(3)
    found = {r.id: r for r in lm_score.score_corpus(docs, "learn", vocabulary=12, hidden=8, n_classes=4, chunk_tokens=700).collect()}
    tokens = [[*(t or "").lower().split(), None] for t in texts]
    c = Counter(w for k, ws in enumerate(tokens) if k % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for k, ws in enumerate(tokens):
        r = found[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) < 1e-6
        assert math.isfinite(r.score) and r.score < 0
    again = {r.id: r.score for r in lm_score.score_corpus(docs, "learn", vocabulary=12, hidden=8, n_classes=4, chunk_tokens=700).collect()}
    assert all(abs(again[k] - found[k].score) < 1e-3 * max(1, abs(found[k].score)) for k in again)


def test_scores_beat_the_base_on_held_out_documents(spark):
    rows = [(k, t, k % 5 != 1) for k, t in enumerate(toy_docs(3000, 4))]
    found = lm_score.score_corpus(spark.createDataFrame(rows, "doc_id long, text string, learn boolean"), "learn", vocabulary=30, hidden=8, n_classes=4).filter("id % 5 = 1").collect()
    assert sum(r.score for r in found) > 0.9 * sum(r.base_score for r in found)


def test_scores_of_empty_tables(spark):
    schema = "doc_id long, text string, learn boolean"
    assert lm_score.score_corpus(spark.createDataFrame([], schema), "learn").count() == 0
    one = lm_score.score_corpus(spark.createDataFrame([(1, "a b", False)], schema), "learn").first()
    assert (one.n_tokens, one.n_known, one.train_tokens, one.base_score) == (3, 0, 0, 0.0)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="no-sidebar">
<div class="site-header">Site</div><nav><a href=/>Home</a></nav><!-- c -->
<main><h1>Head&amp;line</h1><article class="post"><header><h2>Sub</h2></header><p>One&nbsp;two <b>bold</b><br>three<p>Four &lt;five&gt; &#233;
<ul><li>item a<li>item b</ul><table><tr><td>c1<td>c2</table><pre>x
 y</pre><script>var a = "</p>";</script><div class="share-buttons">Share</div><aside>Side</aside></article>
<section id="comments"><article class="comment"><p>I agree</p></article></section></main>
<form><p>Name <input></p></form><div class="cookie-notice">We use</div><div hidden>no</div><footer>Foot</footer></body>"""


def test_page():
    assert html_extract.Page(PAGE, html_extract.lone(PAGE)).main_text() == "Head&line\nSub\nOne two bold three\nFour <five> é\nitem a\nitem b\nc1\nc2\nx y"


@pytest.mark.parametrize(("html", "want"), [
    ("", ""), ("plain text", "plain text"), ("<p>a<p>b <di", "a\nb"), ("<nav><a>x</a><article><p>in</p></article>", "in"), ("<p>1 < 2 & 3", "1 < 2 & 3"),
    ("<div><ul><li><a href=x>menu item</a></ul><p>text here</p></div>", "text here"), ("<p>" + "a" * 200_000 + "</p>", "a" * 200_000), ("<b>" * 5000 + "deep", "deep"),
    ('<img alt="' + "x" * 20_000 + '>leak">text', "text"), ("<p a=it's>b</p><p>it's</p>", "b\nit's"), ("<div>" * 3000 + "</p>" * 3000 + "z", "z"),
    ("<script>never closed", ""), ('<p title="a > b">t</p>', "t"), ('<i title="unclosed>x</i><p>y</p>', "x\ny"), ("</p></div>z", "z"), ("<textarea>q</textarea>r", "r"),
])
def test_odd_pages(html, want):
    assert html_extract.Page(html, html_extract.lone(html)).main_text() == want


def site(n: int) -> list[tuple]:
    rng = random.Random(1)
    say = lambda k: " ".join(rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(k))
    page = lambda k: f'<div class="top">Welcome to our site</div><div class="body"><p>{say(12)} {k}</p><p>{say(9)} {k}</p></div><div class="bottom"><p>Contact us by mail</p></div>'
    return [(k, f"http://h.example.com/{k}", page(k)) for k in range(n)]


def test_repeated_branches_are_cut(spark):
    rows = [*site(8), (100, "http://alone.example.com/", site(1)[0][2]), (101, None, None), (102, "no host", ""), (103, "http://h.example.com/x", site(1)[0][2])]
    rows += [(k, "http://copies.example.com/", site(1)[0][2]) for k in range(200, 206)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, n int")
    found = {r.id: r for r in html_extract.extract(pages).collect()}
    for k in [*range(8), 103]:
        assert "Welcome" not in found[k].text and "Contact" not in found[k].text and len(found[k].text.split("\n")) == 2
    assert found[100].text.startswith("Welcome") and found[101].text == found[102].text == ""
    assert all(found[k].text.startswith("Welcome") for k in range(200, 206))  # copies of one page say nothing of the site
    assert all(r.n_chars == len(r.text) for r in found.values())
    assert html_extract.extract(pages.limit(0)).count() == 0
    joined = {r.id: r.text for r in html_extract.extract(pages, broadcast_rows=0).collect()}
    assert joined == {k: r.text for k, r in found.items()}


def test_the_tree_decides(spark):
    """Menus of changing words, repeated lines and a misleading name, none of which a list of names would settle."""
    rng = random.Random(2)
    say = lambda k: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(99)) for _ in range(k))
    menu = lambda: "".join(f'<div class="q1"><a href="/{k}">{say(2)}</a></div>' for k in range(5))
    texts = {k: (say(4), say(30), say(25)) for k in range(12)}
    page = lambda k: f'<div class="u">{menu()}</div><div class="promo-wrap"><h1>{texts[k][0]}</h1><p>{texts[k][1]}</p><div class="z">Written by our team</div><p>{texts[k][2]}</p></div>'
    pages = spark.createDataFrame([(k, f"http://h.example.org/{k}", page(k)) for k in texts], "page_id long, url string, html string")
    assert {r.id: r.text for r in html_extract.extract(pages).collect()} == {k: "\n".join(t) for k, t in texts.items()}
    off = {r.id: r.text for r in html_extract.extract(pages, threshold=-1.0).collect()}
    assert all("Written by" in off[k] and len(off[k].split("\n")) == 9 for k in texts)


def test_importance_by_the_definition(spark):
    """Presentation and content entropies of a small site against sums over its pages."""
    htmls = [f"<div><p>{a}</p></div><div class=b>same</div><div class=c>{a}<p>x</p></div>" for a in ("k", "k", "l", "m", "n")]
    htmls[4] = htmls[4].replace("<p>x</p>", "<p>x</p><ul><li>y</li></ul>")
    pages = spark.createDataFrame([(k, "http://s.example.org/", h + f"<i>{k}</i>") for k, h in enumerate(htmls)], "page_id long, url string, html string")
    got = {}
    for r in html_extract.style_tree(pages).collect():
        got.setdefault((r.depth, int(r.pages)), []).append((round(r.presentation, 6), None if r.content is None else round(r.content, 6)))
    log, m = math.log, math.log(5)
    entropy = lambda counts: -sum(c / 5 * log(c / 5) for c in counts) / m
    firsts = round(1 - log(2) / m / 4, 6)  # of four texts one is on two pages
    assert sorted(got[1, 5], key=str) == sorted([(0.0, None), (0.0, None), (round(entropy([4, 1]), 6), None), (1.0, 1.0)], key=str)
    assert (1.0, firsts) in got[2, 5] and (1.0, 0.0) in got[2, 5] and (1.0, firsts) in got[3, 5] and (1.0, 0.0) in got[3, 5]


def test_registered_scores_beat_the_base_on_held_out_documents(spark):
    rows = queries()["op6_lm_scoring"](spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) and sum(r.score > r.base_score for r in rows) > 0.8 * len(rows)


def test_hundreds_of_languages(spark):
    rng = random.Random(3)
    tongues = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(6)] for k in range(300)}
    rows = [(k, " ".join(rng.choice(w) for _ in range(30)), code) for k, (code, w) in enumerate(list(tongues.items()) * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, cells=1 << 21)
    assert len(model["codes"]) == 300 and model["slots"] * 300 <= 1 << 21
    found = {r.id: r.lang_pred for r in langid.identify(docs.select("doc_id", "text"), model).collect()}
    assert sum(found[k] == code for k, _, code in rows) > 590
