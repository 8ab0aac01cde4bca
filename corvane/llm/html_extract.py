"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of style nodes: a node is an element's
path of tags, classes, id and role (digits alike), and the text right inside an element
is a leaf of its own. Two entropies give a node's importance (Yi, Liu, Li, "Eliminating
Noisy Information in Web Pages for Data Mining"): a node whose children look alike on
all pages, and a text that all pages repeat, say little. A leaf's content importance is
lessened by its share of characters in links, so a menu whose words differ from page to
page has little as well. A branch of which every node is of low importance is removed
from each page. Besides, only what a browser would not show as text, forms and dialogs,
and words inside a block whose element names them as noise are left out.

Markup gives priors, not verdicts. A node that names itself as navigation, advert,
notice, comments and the like, or that lies outside the article or main part on the
pages that mark one, has a fraction of its importance, unless it holds most of the
unlinked text of its pages and does not name itself as comments, footer or sidebar.
A host of few pages has no entropies to go by; links and priors are left.

Statistics are sums that combine on the map side, so a host with a third of all pages
is no task of its own; only the finished tree of a host, which has the size of its
templates, is looked at as a whole. Pages with the same content count once.

Text of a block: character references decoded, white space to one space (a line break
element too), trimmed; blocks in page order joined by one line feed.

Defined results: null or empty html gives an empty text; pages without a host have no
site, so each is judged alone; repeated rows give a row each; unclosed elements end
with their container; an unfinished tag at the end is dropped; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.scratch import store

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)", re.S)
STOP = re.compile(r"""=\s*(["'])|>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
UNFINISHED = re.compile(r"<(?=[A-Za-z/!?])[^>]*\Z")
NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")

# Elements and names as HTML and common templates use them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
HIDDEN = frozenset("script style noscript template head svg math canvas audio video object embed applet map select option button input textarea datalist progress meter iframe title".split())
FORMS = frozenset("form fieldset dialog".split())
WEAK = frozenset("nav menu search".split())
SOFT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote".split())
STRONG = frozenset("footer aside".split())
ROLES = {"navigation": 1, "banner": 1, "search": 1, "form": 1, "dialog": 1, "alertdialog": 1, "alert": 1, "status": 1, "menu": 1, "menubar": 1, "toolbar": 1, "tablist": 1, "contentinfo": 2, "complementary": 2}
NAMES = {
    n: 1
    for n in (
        "ad ads adsense advert adverts advertisement advertisements advertising adslot sponsor sponsors sponsored promo promos promotion promotions banner banners nav navbar navi navigation menu menus submenu dropdown "
        "breadcrumb breadcrumbs header masthead topbar toolbar cookie cookies consent gdpr notice notices notification notifications alert alerts popup popups modal overlay newsletter subscribe subscription signup login "
        "signin register share sharing sharebar social pagination pager skip toc form search"
    ).split()
} | {n: 2 for n in "footer sidebar sidebars aside widget widgets comment comments commentlist respond disqus reply replies related recommended recommendations recirculation outbrain taboola".split()}
MODIFIERS = frozenset("with has no without is not show hide".split())
LIST_ITEMS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
ARTICLE, MAIN = 2, 1
TEXT = "#text"
SOFT, FIXED, OWN = 1, 2, 4  # links weigh half in paragraphs and headings; documents, articles and main parts stay; the prior begins here


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)}


def name_noise(names: str) -> int:
    """Kind of noise that class names or an id speak of, by the first or last word of each name."""
    worst = 0
    for name in names.split():
        parts = [p.lower() for p in NAME_PART.findall(name)]
        if parts and parts[0] not in MODIFIERS:
            worst = max(worst, NAMES.get(parts[0], 0), NAMES.get(parts[-1], 0))
    return worst


def unseen(given: dict[str, str]) -> bool:
    """Markup that a browser does not show."""
    return bool(given) and ("hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", "")) is not None)


def noise_of(tag: str, given: dict[str, str], top: Element) -> int:
    """The prior of an element by its tag, role and names."""
    if tag in STRONG:
        return 2
    if tag in WEAK or tag == "header" and top.zone != ARTICLE:
        return 1
    if not given or tag in ("html", "body", "main", "header"):
        return 0
    found = max(name_noise(given.get("class", "")), name_noise(given.get("id", "")))
    if tag == "article" and found < 2:
        return 0
    return max(ROLES.get(given.get("role", ""), 0), found)


class Element:
    __slots__ = ("tag", "path", "depth", "noise", "zone", "children", "parent", "flags", "hidden", "gone")

    def __init__(self, tag: str, path: int, depth: int, noise: int, zone: int, parent: int, flags: int = 0, hidden: bool = False, gone: bool = False):
        self.tag, self.path, self.depth, self.noise, self.zone, self.parent = tag, path, depth, noise, zone, parent
        self.flags, self.hidden, self.gone = flags, hidden, gone
        self.children: list[str] = []


class Page:
    """One parsed page: text blocks (element, text, characters in links) of all that is shown.

    ``cut`` holds paths of branches to remove. Noise is 1 where an article inside
    would end it (an unclosed menu before it), 2 where it would not.
    """

    def __init__(self, html: str, cut: frozenset[int] = frozenset()):
        self.html, self.cut, self.known = html, cut, {}
        self.blocks: list[tuple[Element, str, int]] = []
        self.pieces: list[str] = []
        self.linked = 0
        self.link = False
        self.unclosed: set[str] = set()
        root = Element("", 0, 0, 0, 0, 0, FIXED)
        self.stack, self.elements, self.count = [root], [root], Counter()
        self.parse()
        self.flush()

    def path_of(self, parent: Element, label: str) -> int:
        from xxhash import xxh64_intdigest

        key = (parent.path, label)
        if key not in self.known:
            self.known[key] = xxh64_intdigest(f"{parent.path:x}/{label}")
        return self.known[key]

    def flush(self) -> None:
        if self.pieces:
            top = next(e for e in reversed(self.stack) if e.tag not in INLINE)
            text = " ".join(unescape("".join(self.pieces)).split())
            if text:
                if not top.children or top.children[-1] != TEXT:
                    top.children.append(TEXT)
                if self.path_of(top, TEXT) not in self.cut:
                    self.blocks.append((top, text, self.linked))
            self.pieces, self.linked = [], 0

    def text(self, raw: str) -> None:
        top = self.stack[-1]
        if raw and not (top.hidden or top.gone):
            self.pieces.append(raw)
            if self.link:
                self.linked += len(raw)

    def pop_to(self, depth: int) -> None:
        self.flush()
        self.link = False
        self.pop(depth)

    def pop(self, depth: int) -> None:
        for e in self.stack[depth:]:
            self.count[e.tag] -= 1
        del self.stack[depth:]

    def push(self, e: Element) -> None:
        self.stack.append(e)
        self.count[e.tag] += 1

    def tag_end(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` is over; a quoted value is followed however long. -1 if it isn't finished.

        A quote that nothing closes is none; that is found out once a page.
        """
        k = at
        while m := STOP.search(self.html, k):
            quote = m[1]
            if quote is None:
                return m.end()
            close = -1 if quote in self.unclosed else self.html.find(quote, m.end())
            if close < 0:
                self.unclosed.add(quote)
                return self.html.find(">", at) + 1 or -1
            k = close + 1
        return -1

    def parse(self) -> None:
        html, at, search = self.html, 0, TOKEN.search
        while m := search(html, at):
            if m.start() > at:
                self.text(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag, end = m[2].lower(), self.tag_end(m.end())
            if end < 0:
                return
            raw, at = html[at : end - 1], end
            if m[1]:
                self.close(tag)
                continue
            if tag in RAW:
                over = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                if over or tag != "title":
                    at = over.end() if over else len(html)
                continue
            self.open(tag, raw)
        self.text(UNFINISHED.sub("", html[at:]))

    def close(self, tag: str) -> None:
        stack = self.stack
        if tag == "a":
            self.link = False
        if not self.count[tag]:
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                if tag in INLINE:
                    self.pop(k)
                else:
                    self.pop_to(k)
                return
            if tag in INLINE and stack[k].tag not in INLINE:
                return

    def open(self, tag: str, raw: str) -> None:
        top = self.stack[-1]
        if tag in VOID:
            if tag in ("br", "hr"):
                self.text(" ")
            return
        if tag in INLINE:
            if tag == "a":
                self.link = True
            if raw and not top.hidden and ("class" in raw or "id" in raw or "aria" in raw or "style" in raw):
                given = attributes(raw)
                if unseen(given) or noise_of(tag, given, top):  # words inside a block have no statistics of their own
                    self.push(Element(tag, 0, top.depth, top.noise, top.zone, top.path, hidden=True))
            return
        self.flush()
        self.link = False
        while self.stack[-1].tag in INLINE or self.stack[-1].tag == "p":
            self.pop(len(self.stack) - 1)
        if tag in LIST_ITEMS:
            same, within = LIST_ITEMS[tag]
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in within:
                    break
                if self.stack[k].tag in same.split():
                    self.pop_to(k)
                    break
        top = self.stack[-1]
        given = attributes(raw) if raw.strip() else {}
        if top.hidden or tag in HIDDEN or tag in FORMS or unseen(given):
            self.push(Element(tag, 0, top.depth + 1, 2, 0, 0, hidden=True))
            return
        noise = noise_of(tag, given, top)
        own = noise > 0
        main = tag in ("article", "main") and noise < 2
        noise = max(noise, 0 if main and top.noise < 2 else top.noise)
        zone = top.zone
        if not noise:
            zone = max(zone, ARTICLE if tag == "article" or given.get("role") == "article" or given.get("itemprop") == "articleBody" else MAIN if tag == "main" or given.get("role") == "main" else 0)
        names = sorted({re.sub(r"\d+", "0", x) for x in f"{given.get('class', '')} {given.get('id', '')} {given.get('role', '')}".split()}) if given else []
        label = ".".join([tag, *names, *(["clear"] if main and top.noise == 1 else [])])
        path = self.path_of(top, label)
        flags = SOFT * (tag in SOFT_TAGS) | FIXED * (tag in ("html", "body") or main and not noise) | OWN * own
        new = Element(tag, path, top.depth + 1, noise, zone, top.path, flags, False, (top.gone and not (main and not noise)) or path in self.cut)
        self.push(new)
        self.elements.append(new)
        if not top.children or top.children[-1] != label:
            top.children.append(label)

    def main_text(self) -> str:
        return "\n".join(text for _, text, _ in self.blocks)

    def statistics(self) -> np.ndarray:
        """Sums of each path, by kind: see ``STATS``."""
        from xxhash import xxh64_intdigest

        counts: Counter = Counter()
        where = {e.path: (e.parent, e.depth, e.noise, e.flags) for e in reversed(self.elements)}
        best = max((e.zone for e, _, _ in self.blocks), default=0)
        mass, marked = Counter(), set()
        for e, text, linked in self.blocks:
            path, linked = self.path_of(e, TEXT), min(linked, len(text))
            where[path] = (e.path, e.depth + 1, e.noise, e.flags & SOFT)
            counts[path, 1, xxh64_intdigest(text)] += 1
            counts[path, 3, 0] += len(text)
            counts[path, 4, 0] += linked
            mass[path] += len(text) - linked
            if e.zone >= best or e.tag == "h1" and e.zone == MAIN:
                marked.add(path)
        for e in self.elements:
            counts[e.path, 0, xxh64_intdigest("|".join(e.children))] += 1
        unlinked = max(sum(mass.values()), 1)
        for path in sorted(where, key=lambda p: -where[p][1]):  # leaves first
            counts[path, 2, 0] = 1
            up = where[path][0]
            if path not in mass:
                continue
            if path not in marked:
                counts[path, 5, 0] = 1
            counts[path, 6, 0] = mass[path] * 10_000 // unlinked
            if up != path:
                mass[up] += mass[path]
                if path in marked:
                    marked.add(up)
        out = np.zeros(len(counts), STATS)
        for k, ((path, kind, feature), n) in enumerate(sorted(counts.items())):
            out[k] = (path, *where[path], kind, feature, n)
        return out


#: Kinds of ``n``: 0 sequences of children, 1 texts, 2 presence, 3 characters, 4 characters in links, 5 presence of a branch
#: that lies outside the page's marked part, 6 share of the page's unlinked characters in the branch, of 10,000.
STATS = np.dtype([("path", "<u8"), ("parent", "<u8"), ("depth", "<u4"), ("noise", "<u1"), ("flags", "<u1"), ("kind", "<u1"), ("feature", "<u8"), ("n", "<u4")])
NODE = {"path": np.int64, "parent": np.int64, "depth": np.int64, "noise": np.int64, "flags": np.int64, "pages": float, "presentation": float, "content": float, "chars": float, "linked": float, "outside": float, "mass": float}


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def style_tree(pages: DataFrame, url: str = "url", html: str = "html", least_pages: int = 4) -> DataFrame:
    """Style nodes of each host: the columns of ``NODE``. Nodes on less than ``least_pages`` pages have no entropies and count as important."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            hosts, packed = [], []
            for host, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = raw.as_py()
                if text:
                    hosts.append(host)
                    packed.append(Page(text).statistics().tobytes())
            same = np.array([xxh64_intdigest(p) for p in packed], np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(same), pa.array(packed, pa.binary())], names=["host", "same", "packed"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(p.as_py(), STATS) for p in batch.column(1)]
            if not parts:
                continue
            flat = np.concatenate(parts)
            rows = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            signed = [pa.array(np.ascontiguousarray(flat[c]).view(np.int64)) for c in ("path", "parent", "feature")]
            small = [pa.array(flat[c].astype(np.int32)) for c in ("depth", "noise", "flags", "kind")]
            yield pa.record_batch([batch.column(0).take(pa.array(rows)), *signed, *small, pa.array(flat["n"].astype(np.int64))], names=["host", "path", "parent", "feature", "depth", "noise", "flags", "kind", "n"])

    held = pages.select(host_of(F.col(url)).alias("host"), F.col(html)).filter("host <> ''")
    once = held.mapInArrow(count, "host string, same bigint, packed binary").groupBy("host", "same").agg(F.first("packed").alias("packed"))
    rows = once.select("host", "packed").mapInArrow(spread, "host string, path bigint, parent bigint, feature bigint, depth int, noise int, flags int, kind int, n bigint")
    n, where = F.col("n").cast("double"), ("parent", "depth", "noise", "flags")
    sums = rows.groupBy("host", "path", "kind", "feature").agg(*[F.first(c).alias(c) for c in where], F.sum(n).alias("f"), F.sum(n * F.ln(n)).alias("s"))
    f, of = F.col("f"), lambda kind: F.col("kind") == kind
    nodes = sums.groupBy("host", "path").agg(
        *[F.first(c).alias(c) for c in where], F.sum(F.when(of(0), f)).alias("a"), F.sum(F.when(of(0), f * F.ln(f))).alias("b"),
        F.sum(F.when(of(1), F.ln(f) - F.col("s") / f)).alias("c"), F.count(F.when(of(1), 1)).alias("texts"),
        *[F.coalesce(F.sum(F.when(of(k), f)), F.lit(0.0)).alias(c) for k, c in ((2, "pages"), (3, "chars"), (4, "linked"), (5, "outside"), (6, "mass"))],
    )
    few, log_m = F.col("pages") < least_pages, F.ln("pages")
    presentation = F.when(few | F.col("a").isNull(), 1.0).otherwise((F.ln("a") - F.col("b") / F.col("a")) / log_m)
    content = F.when(F.col("texts") > 0, F.when(few, 1.0).otherwise(1 - F.col("c") / (F.col("texts") * log_m)))
    return nodes.withColumns({"presentation": presentation, "content": content}).select("host", *NODE)


def composite(node: dict[str, np.ndarray], gamma: float, prior: float, most_mass: float) -> np.ndarray:
    """Highest importance in the branch of each of one host's nodes; -1 where there is no text below.

    From the leaves up: (1 - gamma^k) of a node's presentation and gamma^k of what lies
    below it, for k kinds of children; a leaf has its content's importance, less its
    links. Where markup speaks against a node, ``prior`` of that counts; but not within
    a branch that has ``most_mass`` of its pages' unlinked text.
    """
    path, parent, pages, noise, flags = (node[c] for c in ("path", "parent", "pages", "noise", "flags"))
    n = len(path)
    at = {p: k for k, p in enumerate(path.tolist())}
    up = [at.get(p, -1) if p != q else -1 for p, q in zip(parent.tolist(), path.tolist(), strict=True)]
    order = np.argsort(node["depth"], kind="stable").tolist()
    against = (noise > 0) | (node["outside"] >= 0.5 * pages)
    heavy = (noise < 2) & (node["mass"] > most_mass * 10_000 * pages)
    spared = np.zeros(n, bool)
    for k in order:
        inherits = up[k] >= 0 and spared[up[k]] and not flags[k] & OWN
        spared[k] = against[k] and (heavy[k] or inherits)
    link = node["linked"] / np.maximum(node["chars"], 1) * np.where(flags & SOFT, 0.5, 1.0)
    leaf = node["content"] * (1 - link)
    most, below, weight, kinds = np.full(n, -1.0), np.zeros(n), np.zeros(n), np.zeros(n)
    for k in reversed(order):
        if np.isnan(leaf[k]):
            if not weight[k]:
                continue
            g = gamma ** kinds[k]
            own = (1 - g) * node["presentation"][k] + g * below[k] / weight[k]
        else:
            own = leaf[k]
        most[k] = max(most[k], own * (prior if against[k] and not spared[k] else 1.0))
        if up[k] >= 0:
            below[up[k]] += own * pages[k]
            weight[up[k]] += pages[k]
            kinds[up[k]] += 1
            most[up[k]] = max(most[up[k]], most[k])
    return most


def noisy(node: dict[str, np.ndarray], threshold: float = 0.4, gamma: float = 0.9, prior: float = 0.3, most_mass: float = 0.6) -> np.ndarray:
    """Paths of the topmost branches of one host all of whose nodes are below ``threshold``."""
    most = composite(node, gamma, prior, most_mass)
    low = (most >= 0) & (most < threshold) & (node["flags"] & FIXED == 0)
    return node["path"][low & ~np.isin(node["parent"], node["path"][low])]


def lone(html: str, **options) -> frozenset[int]:
    """What to cut from a page that belongs to no site: links and priors alone."""
    rows = Page(html).statistics()
    path, back = np.unique(rows["path"], return_inverse=True)
    first = np.zeros(len(path), np.int64)
    first[back[::-1]] = np.arange(len(rows))[::-1]
    total = lambda kind: np.bincount(back, weights=np.where(rows["kind"] == kind, rows["n"], 0), minlength=len(path))
    node = {c: rows[c][first].astype(np.int64) for c in ("depth", "noise", "flags")}
    node |= {"path": path.view(np.int64), "parent": np.ascontiguousarray(rows["parent"][first]).view(np.int64), "pages": np.ones(len(path)), "presentation": np.ones(len(path))}
    node |= {"content": np.where(total(1) > 0, 1.0, np.nan), "chars": total(3), "linked": total(4), "outside": total(5), "mass": total(6)}
    return frozenset(noisy(node, **options).view(np.uint64).tolist())


def low_branches(tree: DataFrame, **options) -> DataFrame:
    """(host, cut): paths of the branches to remove; see :func:`noisy`."""
    kinds = {c: pa.int64() if t is np.int64 else pa.float64() for c, t in NODE.items()}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            columns = {c: np.concatenate([p.column(c).cast(kinds[c]).to_numpy(zero_copy_only=False) for p in parts]) for c in NODE}
            return pa.record_batch([parts[0].column("host").slice(0, 1), pa.array([noisy(columns, **options).tolist()], pa.list_(pa.int64()))], names=["host", "cut"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            host = batch.column("host").to_pylist()
            cut = [0, *[k for k in range(1, len(host)) if host[k] != host[k - 1]], len(host)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if held and held[0].column("host")[0].as_py() != host[a]:
                    yield one(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield one(held)

    return tree.repartition("host").sortWithinPartitions("host").mapInArrow(judge, "host string, cut array<bigint>").filter(F.size("cut") > 0)


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", least_pages: int = 4, broadcast_rows: int = 200_000, spread: int = 32, **options) -> DataFrame:
    """Per page: id, url, text, n_chars; ``options`` are those of :func:`noisy`.

    The branches to cut are broadcast if they are at most ``broadcast_rows`` (8 bytes
    each, counted first), else joined by host, each host in ``spread`` parts.
    """
    cuts = store(low_branches(style_tree(pages, url, html, least_pages), **options), "branches")
    size = cuts.agg(F.sum(F.size("cut") + 8)).first()[0] or 0
    keyed = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    if size <= broadcast_rows:
        keyed = keyed.join(F.broadcast(cuts), "host", "left")
    else:
        part = F.pmod(F.xxhash64("html", "url"), F.lit(spread)).alias("part")
        keyed = keyed.select("*", part).join(cuts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))).alias("part")), ["host", "part"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for raw, host, cut in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), strict=True):
                body = raw.as_py()
                if body:
                    own = frozenset(x & (2**64 - 1) for x in cut.as_py() or ()) if host else lone(body, **options)
                    texts.append(Page(body, own).main_text())
                else:
                    texts.append("")
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kind, link = (pages.schema[c].dataType.simpleString() for c in (id_col, url))
    return keyed.select("id", "url", "html", "host", "cut").mapInArrow(run, f"id {kind}, url {link}, text string, n_chars bigint")
