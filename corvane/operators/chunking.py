"""Chunkers. A chunk is a verbatim slice of its text, with its offsets.

Greedy packing is sequential within a text, so it runs as ``mapInArrow`` over rows:
texts are never gathered. Fixed windows, routing, passages and semantic boundaries
are expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import code_ratio
from corvane.functions.vectors import cosine

TOKEN = re.compile(r"[A-Za-z0-9_]+|[^\s]")
HEADING = re.compile(r" {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z])|\n\n"
#: Extensions and their languages.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust", "rb": "ruby",
    "php": "php", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "swift": "swift", "kt": "kotlin", "scala": "scala", "sh": "bash", "sql": "sql",
}
#: A line that starts a top-level unit of code.
UNIT = re.compile(r"(?:@\w|(?:export\s+|public\s+|private\s+|static\s+|async\s+|pub\s+)*(?:def|class|function|func|fn|interface|struct|enum|impl|trait|module|type)\b)")

#: Characters of chunks (and so many for each of their rows) that a task holds before it hands them on.
OUT_CHARS = 2_000_000


@dataclass(frozen=True)
class Config:
    max_chars: int = 2000
    overlap: int = 200

    @property
    def max_tokens(self) -> int:
        return -(-self.max_chars // 4)


def tokens(text: str) -> int:
    return sum(max(1, -(-len(t) // 4)) if t.isascii() and (t.isalnum() or "_" in t) else 1 for t in TOKEN.findall(text))


def fits(text: str, cfg: Config) -> bool:
    return len(text) <= cfg.max_chars and tokens(text) <= cfg.max_tokens


def trim(text: str, a: int, b: int) -> tuple[int, int]:
    body = text[a:b]
    return (a + len(body) - len(body.lstrip()), a + len(body.rstrip())) if body.strip() else (b, b)


def budget_end(text: str, a: int, b: int, cfg: Config) -> int:
    """End of the longest prefix of text[a:b] within the token budget."""
    left = cfg.max_tokens
    for m in TOKEN.finditer(text, a, b):
        word = m.group()
        if word.isascii() and (word.isalnum() or "_" in word):
            room = min(len(word), 4 * left)
            left -= -(-room // 4)
            if room < len(word):
                return m.start() + room
        else:
            left -= 1
        if left <= 0:
            return m.end()
    return b


def hard_split(text: str, a: int, b: int, cfg: Config) -> list[tuple[int, int]]:
    """Windows of an oversize stretch: cut at white space in the last third if there is any, stepping back by the overlap."""
    out, back = [], max(0, min(cfg.overlap, cfg.max_chars - 1))
    while a < b:
        stop = budget_end(text, a, min(b, a + cfg.max_chars), cfg)
        if stop < b:
            low = a + max(1, (stop - a) * 2 // 3)
            stop = next((k for k in range(stop - 1, low - 1, -1) if text[k].isspace()), stop)
        x, y = trim(text, a, stop)
        if x < y:
            out.append((x, y))
        if stop >= b:
            break
        a = stop - back if stop - back > a else stop
    return out


def overlap_tail(text: str, a: int, b: int, end: int, cfg: Config) -> int:
    """Start of the longest tail of text[a:b], up to the overlap, that fits together with text[b:end]; ``b`` if none does."""
    if cfg.overlap <= 0:
        return b
    low, high = max(a, b - min(cfg.overlap, cfg.max_chars)), b
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(text[mid:end], cfg) else (mid + 1, high)
    return low if low < b and fits(text[low:end], cfg) else b


def pack(text: str, parts: list[tuple[int, int]], cfg: Config) -> list[tuple[int, int]]:
    """Greedy chunks of consecutive ``parts``; a new chunk starts with the tail of the one before."""
    out: list[tuple[int, int]] = []
    now = before = None
    for a, b in parts:
        if not fits(text[a:b], cfg):
            if now:
                out.append(now)
            split = hard_split(text, a, b, cfg)
            out += split
            before, now = (split[-1] if split else now), None
        elif now is None:
            now = (overlap_tail(text, *before, b, cfg) if before else a, b)
            if before and now[0] == before[1]:
                now = (a, b)
            before = None
        elif fits(text[now[0] : b], cfg):
            now = (now[0], b)
        else:
            out.append(now)
            start = overlap_tail(text, *now, b, cfg)
            now = (start if start < now[1] else a, b)
    return out + ([now] if now else [])


def lines_of(text: str) -> Iterator[tuple[int, str]]:
    at = 0
    for line in text.splitlines(keepends=True):
        yield at, line.rstrip("\r\n\x0b\x0c\x1c\x1d\x1e\x85  ")
        at += len(line)


def markdown_sections(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, titles of the headings above) of each section; headings inside fences are text."""
    cuts: list[tuple[int, list[str]]] = [(0, [])]
    stack: list[tuple[int, str]] = []
    fence = ""
    for at, line in lines_of(text):
        m = FENCE.match(line)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line[m.end() :].strip():
                fence = ""
            continue
        if m:
            fence = m[1]
            continue
        h = HEADING.fullmatch(line)
        if h and h[2].strip():
            stack = [s for s in stack if s[0] < len(h[1])] + [(len(h[1]), h[2].strip())]
            cuts.append((at, [t for _, t in stack]))
    ends = [c[0] for c in cuts[1:]] + [len(text)]
    return [(*trim(text, a, b), titles) for (a, titles), b in zip(cuts, ends, strict=True) if text[a:b].strip()]


def paragraphs(text: str, a: int, b: int) -> list[tuple[int, int]]:
    out, at = [], a
    for part in text[a:b].split("\n\n"):
        if part.strip():
            out.append(trim(text, at, at + len(part)))
        at += len(part) + 2
    return out


def markdown_chunks(text: str, cfg: Config) -> list[dict]:
    out = []
    for a, b, titles in markdown_sections(text):
        spans = [(a, b)] if fits(text[a:b], cfg) else pack(text, paragraphs(text, a, b), cfg)
        out += [{"start_char": x, "end_char": y, "section_path": " > ".join(titles) or None} for x, y in spans]
    return out


def code_chunks(text: str, cfg: Config) -> list[dict]:
    """Units that start at the left margin, packed; oversize ones by lines."""
    starts = [0] + [at for at, line in lines_of(text) if at and UNIT.match(line)]
    units = [(a, b) for a, b in zip(starts, starts[1:] + [len(text)], strict=True) if text[a:b].strip()]
    parts: list[tuple[int, int]] = []
    for a, b in units:
        if fits(text[a:b], cfg):
            parts.append((a, b))
        else:
            at = a
            for line in text[a:b].splitlines(keepends=True):
                if line.strip():
                    parts.append((at, at + len(line)))
                at += len(line)
    spans = pack(text, parts, Config(cfg.max_chars, 0))
    return [{"start_char": a, "end_char": b, "section_path": f"lines {text.count(chr(10), 0, a) + 1}-{text.count(chr(10), 0, max(a, b - 1)) + 1}"} for a, b in spans]


def sentence_chunks(text: str, cfg: Config) -> list[dict]:
    """Sentences and paragraphs, packed greedily."""
    parts, at = [], 0
    for m in re.finditer(SENTENCE_END, text):
        parts.append((at, m.start()))
        at = m.end()
    parts = [trim(text, a, b) for a, b in [*parts, (at, len(text))] if text[a:b].strip()]
    return [{"start_char": a, "end_char": b, "section_path": None} for a, b in pack(text, parts, cfg)]


def table_chunks(text: str, cfg: Config) -> list[dict]:
    """Rows of a table under its heading and header line, packed without overlap; the header is named, not repeated in the slice."""
    out = []
    for a, b, titles in markdown_sections(text):
        spans = [(a + m.start(), a + m.end()) for m in re.finditer(r"[^\n]+", text[a:b])]
        out += [{"start_char": x, "end_char": y, "section_path": " > ".join(titles) or None} for x, y in pack(text, spans, Config(cfg.max_chars, 0))]
    return out


def hard_chunks(text: str, cfg: Config) -> list[dict]:
    return [{"start_char": a, "end_char": b, "section_path": None} for a, b in hard_split(text, 0, len(text), cfg)]


STRATEGIES: dict[str, Callable[[str, Config], list[dict]]] = {"hard_split": hard_chunks, "markdown": markdown_chunks, "code": code_chunks, "semantic_heuristic": sentence_chunks, "xlsx": table_chunks}


def register_strategy(name: str, chunker: Callable[[str, Config], list[dict]]) -> None:
    """A strategy of one's own: text and config to rows of start_char, end_char, section_path."""
    STRATEGIES[name] = chunker


def chunk(docs: DataFrame, strategy: str, cfg: Config = Config(), id_col: str = "document_id", text: str = "text") -> DataFrame:
    """(document_id, chunk_index, text, start_char, end_char, token_count, word_count, section_path); null texts have no chunk.

    Texts are taken one by one, and chunks handed on whenever they make ``OUT_CHARS``.
    """
    cut = STRATEGIES[strategy]
    kind = docs.schema[id_col].dataType
    names = ["document_id", "chunk_index", "text", "start_char", "end_char", "token_count", "word_count", "section_path"]
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]

    def made(keys: pa.Array, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else ((),) * len(kinds)
        return pa.record_batch([keys.take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            at, rows, held = [], [], 0
            for i in range(batch.num_rows):
                body = texts[i].as_py()
                for n, c in enumerate(cut(body, cfg)):
                    t = body[c["start_char"] : c["end_char"]]
                    at.append(i)
                    rows.append((n, t, c["start_char"], c["end_char"], tokens(t), len(t.split()), c["section_path"]))
                    held += len(t) + 500
                    if held >= OUT_CHARS:
                        yield made(keys, at, rows)
                        at, rows, held = [], [], 0
            yield made(keys, at, rows)

    return docs.filter(F.col(text).isNotNull()).select(id_col, text).mapInArrow(run, f"document_id {kind.simpleString()}, chunk_index int, text string, start_char int, end_char int, token_count int, word_count int, section_path string")


def fixed_windows(docs: DataFrame, size: int, stride: int, id_col: str = "document_id", text: str = "text") -> DataFrame:
    """Windows of ``size`` characters, ``stride`` apart, without looking at the text.

    A text is cut into pieces of ``stride`` characters in one pass; a window is a piece
    and what it needs of those that follow.
    """
    def window(p: Column, i: Column) -> Column:
        whole, rest = divmod(size - stride, stride) if size > stride else (0, 0)
        following = [F.coalesce(F.get(F.col("_p"), i + k), F.lit("")) for k in range(1, whole + 1)]
        last = F.left(F.coalesce(F.get(F.col("_p"), i + whole + 1), F.lit("")), F.lit(rest))
        return F.concat(p, *following, last) if size >= stride else F.left(p, F.lit(size))

    cut = docs.filter(F.length(text) > 0).select(F.col(id_col).alias("document_id"), F.length(text).alias("_n"), F.regexp_extract_all(F.col(text), F.lit(f"(?s)(.{{1,{stride}}})"), 1).alias("_p"))
    each = cut.select("document_id", "_n", F.posexplode(F.transform("_p", window)).alias("chunk_index", "text"))
    start = F.col("chunk_index") * stride
    return each.select("document_id", "chunk_index", start.alias("start_char"), F.least(start + size, F.col("_n")).alias("end_char"), "text")


def route(mime: Column, filename: Column, text: Column) -> Column:
    """Name of the strategy: tables by type, code by type or by more than a tenth of code-like lines, else markdown."""
    ext = F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1))
    table = ext.isin("xlsx", "xlsm") | F.contains(mime, F.lit("spreadsheetml"))
    code = ext.isin(*LANGUAGES) | mime.rlike(r"^(text/x-|application/(javascript|typescript))")
    return F.when(F.coalesce(table, F.lit(False)), "xlsx").when(F.coalesce(code, F.lit(False)) | (code_ratio(text) > 0.1), "code").otherwise("markdown")


def locate_bounds(full: Column, part: Column, search_start: Column) -> Column:
    """Struct of start_char, end_char and exact: where ``part`` lies from ``search_start`` on, or an estimate."""
    at = F.call_function("locate", part, full, search_start + 1)
    start = F.when(at > 0, at - 1).otherwise(search_start)
    return F.struct(start.alias("start_char"), F.when(at > 0, start + F.length(part)).otherwise(F.least(F.length(full), search_start + F.length(part))).alias("end_char"), (at > 0).alias("exact"))


def semantic_groups(sentences: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Sentences (document_id, n, text, vec) to chunks: a new one where neighbors' cosine is below ``threshold``."""
    w = Window.partitionBy("document_id").orderBy("n")
    sim = F.round(cosine(F.col("vec"), F.lag("vec").over(w)), 9)
    marked = sentences.withColumn("_new", F.coalesce((sim < threshold).cast("int"), F.lit(0))).withColumn("chunk_index", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("document_id", "chunk_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda s: s["text"]), " ").alias("text"), F.count(F.lit(1)).alias("sentences"))


def passthrough(docs: DataFrame, chunks: str, embedding_texts: str | None = None, id_col: str = "document_id") -> DataFrame:
    """Chunks that come ready as an array; embedding texts, if given, must be as many. Offsets are not known."""
    if embedding_texts is None:
        return docs.select(F.col(id_col).alias("document_id"), F.posexplode(chunks).alias("chunk_index", "text")).withColumn("embedding_text", F.col("text"))
    same = F.when(F.size(chunks) == F.size(embedding_texts), F.arrays_zip(F.col(chunks).alias("text"), F.col(embedding_texts).alias("embedding_text"))).otherwise(F.raise_error(F.lit("as many embedding texts as chunks")))
    return docs.select(F.col(id_col).alias("document_id"), F.posexplode(same).alias("chunk_index", "c")).select("document_id", "chunk_index", F.col("c")[chunks].alias("text"), F.col("c")[embedding_texts].alias("embedding_text"))


def assign_figures(chunks: DataFrame, figures: DataFrame) -> DataFrame:
    """Chunks with the one figure anchored in them; a chunk with none or several has null.

    ``figures``: document_id, figure_id, char. Of overlapping chunks around an anchor
    the one that starts last has it.
    """
    inside = figures.join(chunks.select("document_id", "chunk_index", "start_char", "end_char"), "document_id").filter("char >= start_char and char < end_char")
    w = Window.partitionBy("document_id", "figure_id").orderBy(F.desc("start_char"))
    own = inside.withColumn("_n", F.row_number().over(w)).filter("_n = 1").groupBy("document_id", "chunk_index").agg(F.count(F.lit(1)).alias("_c"), F.min("figure_id").alias("figure_id"))
    return chunks.join(own.filter("_c = 1").drop("_c"), ["document_id", "chunk_index"], "left")


def page_of_chunk(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """The page (document_id, page, start_char, end_char) that most of a chunk lies on; the earlier on a tie."""
    p = pages.select("document_id", "page", F.col("start_char").alias("_a"), F.col("end_char").alias("_b"))
    over = F.least("end_char", "_b") - F.greatest("start_char", "_a")
    both = chunks.join(p, "document_id").withColumn("_o", over).filter("_o > 0")
    best = both.groupBy("document_id", "chunk_index").agg(F.max(F.struct("_o", (-F.col("page")).alias("p"))).alias("_m"))
    return chunks.join(best.select("document_id", "chunk_index", (-F.col("_m.p")).alias("page_number")), ["document_id", "chunk_index"], "left")
