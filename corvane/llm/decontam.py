"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` writes the index: one row per segment of documents, with the
segment's term dictionary, and for each term the ascending list of its word
positions (documents lie one after another with a gap, so that no match crosses
them). The benchmark is matched in blocks of bounded size against every segment:
for each test window the list of its rarest term, shifted by the term's offset,
gives the candidates, which binary search in the shifted lists of the other terms
then thins out, rarest first. Segments are dealt by document, so nothing is shuffled.

Defined results: null or wordless texts have no words and match nothing; items
without words are not searched for; items without id are, and all of them are one
null at the end of ``items``; an item of fewer words than a window is one window;
repeated rows are matched each on its own; empty tables give no matches.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.encoding import forget
from corvane.llm.scratch import give_back, store

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


def sorted_items(items: Iterable[str | None]) -> list[str | None]:
    return sorted(items, key=lambda x: (x is None, x or ""))


class Terms(dict):
    """Words to numbers; a new word gets the next one."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


class Segment:
    """Positional postings of some documents."""

    def __init__(self, lengths: np.ndarray, terms: list[bytes], offsets: np.ndarray, positions: np.ndarray):
        self.lengths, self.terms, self.offsets, self.positions = lengths, terms, offsets, positions
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)]).astype(np.int64)

    @classmethod
    def build(cls, docs: Iterable[list[bytes]]) -> Segment:
        terms = Terms()
        return cls.of(terms, [terms.numbers(ws) for ws in docs])

    @classmethod
    def of(cls, terms: Terms, docs: list[np.ndarray]) -> Segment:
        """Of documents given as the numbers that ``terms`` has for their words."""
        flat = np.concatenate([np.zeros(0, np.int32), *docs])
        lengths = np.array([len(x) for x in docs], dtype=np.int64)
        order = np.argsort(flat, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(terms)))])
        return cls(lengths, list(terms), offsets, order + np.repeat(np.arange(len(docs)), lengths)[order])

    def listed(self) -> np.ndarray:
        """All postings as one ascending sequence of (term, position) in one number, so that many lists are searched at once."""
        return np.repeat(np.arange(len(self.terms)) * self.span, np.diff(self.offsets)) + self.positions

    @property
    def span(self) -> int:
        return int(self.starts[-1]) + 1

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.offsets[term] : self.offsets[term + 1]]

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1


class TestBlock:
    """Distinct windows of some benchmark items, as rows of term numbers (-1 past a short window's end)."""

    __test__ = False

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], size: int):
        terms: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, ws in items:
            nums = [terms.setdefault(w, len(terms)) for w in ws]
            for at in range(max(len(nums) - size, 0) + 1 if nums else 0):
                found.setdefault(tuple(nums[at : at + size]), set()).add(item)
        self.terms = list(terms)
        self.windows = np.full((len(found), size), -1, np.int32)
        for k, w in enumerate(found):
            self.windows[k, : len(w)] = w
        self.lengths = (self.windows >= 0).sum(axis=1)
        self.items = [sorted_items(x) for x in found.values()]

    def local(self, seg: Segment) -> np.ndarray:
        """Segment term of each block term; -1 if the segment lacks it."""
        known = {t: k for k, t in enumerate(seg.terms)}
        return np.array([known.get(t, -1) for t in self.terms], dtype=np.int32)


def phrase_matches(seg: Segment, block: TestBlock, at_once: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """(start position, window number) of all exact occurrences."""
    if not len(block.windows) or not len(seg.terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    local, freq = block.local(seg), np.diff(seg.offsets)
    used = block.windows >= 0
    rows = np.where(used, local[block.windows], -2)
    whole = np.flatnonzero((rows != -1).all(axis=1))
    rows = rows[whole]
    cost = np.where(rows >= 0, freq[rows], np.iinfo(np.int64).max)
    by_rarity = np.argsort(cost, axis=1, kind="stable")
    listed = seg.listed()
    todo = np.cumsum(np.take_along_axis(cost, by_rarity[:, :1], axis=1)[:, 0]) if len(rows) else np.zeros(0, np.int64)
    out_at, out_w, first = [], [], 0
    while first < len(rows):
        last = max(first + 1, int(np.searchsorted(todo, (todo[first - 1] if first else 0) + at_once, "right")))
        part = np.arange(first, last)
        anchor = by_rarity[part, 0]
        term = rows[part, anchor]
        n = freq[term]
        w = np.repeat(part, n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = seg.positions[np.repeat(seg.offsets[term], n) + inner] - np.repeat(anchor, n)
        keep = (start >= 0) & (start + block.lengths[whole[w]] <= seg.starts[-1])
        start, w = start[keep], w[keep]
        for rank in range(1, rows.shape[1]):
            col = by_rarity[w, rank]
            want = rows[w, col].astype(np.int64)  # times the span below, which 32 bits do not hold
            shifted = want * seg.span + start + col  # where the term's list holds the candidate, shifted by the term's place
            keep = (want < 0) | (listed[np.minimum(np.searchsorted(listed, shifted), len(listed) - 1)] == shifted)
            start, w = start[keep], w[keep]
            if not len(start):
                break
        out_at.append(start)
        out_w.append(whole[w])
        first = last
    return (np.concatenate(out_at), np.concatenate(out_w)) if out_at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def proximity_matches(seg: Segment, terms: list[bytes], slop: int) -> np.ndarray:
    """First positions of the windows of ``slop`` + 1 words of one document that begin with one of ``terms`` and hold all of them.

    The rarest term's list gives the places to look at; the matches do not depend on which term that is.
    """
    known = {t: k for k, t in enumerate(seg.terms)}
    nums = [known.get(t, -1) for t in dict.fromkeys(terms)]
    if not nums or min(nums) < 0:
        return np.zeros(0, np.int64)
    lists = sorted((seg.postings(k) for k in nums), key=len)
    found = []
    for k, at in enumerate(lists):
        for other in lists[:k] + lists[k + 1 :]:
            doc = seg.document(at)
            last = np.minimum(at + slop, seg.starts[doc] + seg.lengths[doc] - 1)
            j = np.searchsorted(other, at)
            at = at[(j < len(other)) & (other[np.minimum(j, len(other) - 1)] <= last)]
        found.append(at)
    return np.sort(np.concatenate(found))


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text", segment_bytes: int = 6 << 20, with_rows: bool = False) -> DataFrame:
    """The stored index of ``docs``: a row per segment of about ``segment_bytes`` of text.

    With ``with_rows`` a segment also keeps its rows of ``docs`` whole (``stored``, an
    Arrow stream), so that what is found need not be joined with the table again.
    """

    kind = docs.schema[id_col].dataType.simpleString()
    names = docs.columns if with_rows else [id_col, text]
    places = names.index(id_col), names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        return index_rows(batches, places, segment_bytes, with_rows, TaskContext.get().partitionId() << 32)

    schema = f"segment bigint, ids array<{kind}>, lengths array<bigint>, terms binary, offsets binary, positions binary" + ", stored binary" * with_rows
    return store(docs.select(F.struct(*[F.col(f"`{c}`").alias(c if with_rows else f"_{k}") for k, c in enumerate(names)]).alias("row")).mapInArrow(run, schema), "postings")


def index_rows(batches: Iterable[pa.RecordBatch], places: tuple[int, int], segment_bytes: int, with_rows: bool, number: int = 0) -> Iterator[pa.RecordBatch]:
    """Index rows of one partition, numbered from ``number``; ``places`` tells the id and the text among the fields of the batches' only column.

    A worker holds numbers of the words of a segment, and the words of one document. It
    is used again by stage after stage, so it first drops the encoder of an earlier one,
    and gives its free memory back after each segment.
    """
    forget()
    terms, ids, held, rows, size, kind = Terms(), [], [], [], 0, pa.int64()

    def row() -> pa.RecordBatch:
        seg = Segment.of(terms, held)
        columns = [
            pa.array([number], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([seg.lengths.tolist()], pa.list_(pa.int64())), pa.array([b"\n".join(seg.terms)], pa.binary()),
            pa.array([seg.offsets.astype("<u4").tobytes()], pa.binary()), pa.array([seg.positions.astype("<u4").tobytes()], pa.binary()),
        ]
        names = ["segment", "ids", "lengths", "terms", "offsets", "positions"]
        if with_rows:
            columns, names = [*columns, pa.array([to_stream(rows)], pa.binary())], [*names, "stored"]
        return pa.record_batch(columns, names=names)

    for batch in batches:
        keys, texts = (batch.column(0).field(k) for k in places)
        kind, first = keys.type, 0
        for k, (key, text) in enumerate(zip(keys, texts.cast(pa.large_binary()), strict=True)):
            raw = text.as_py()
            ids.append(key.as_py())
            held.append(terms.numbers(words_of(raw)))
            size += len(raw or b"") + 64
            if size >= segment_bytes:
                rows.append(batch.slice(first, k + 1 - first))
                yield row()
                terms, ids, held, rows, size, number, first = Terms(), [], [], [], 0, number + 1, k + 1
                give_back()
        if first < batch.num_rows and with_rows:
            rows.append(batch.slice(first))
    if ids:
        yield row()
    del terms, ids, held, rows
    give_back()


def to_stream(rows: list[pa.RecordBatch]) -> bytes:
    """The whole rows (the only column) of some batches, as a compressed Arrow stream."""
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, pa.schema([("row", rows[0].column(0).type)]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for batch in rows:
            out.write_batch(pa.record_batch([batch.column(0)], names=["row"]))
    return sink.getvalue()


def from_stream(raw: bytes | pa.Buffer) -> Iterator[pa.StructArray]:
    with pa.ipc.open_stream(raw) as given:
        for batch in given:
            yield batch.column(0)


def read_segment(row: dict) -> Segment:
    terms = row["terms"].split(b"\n") if row["terms"] else []
    return Segment(np.array(row["lengths"], dtype=np.int64), terms, np.frombuffer(row["offsets"], "<u4").astype(np.int64), np.frombuffer(row["positions"], "<u4").astype(np.int64))


def test_blocks(benchmark: DataFrame, id_col: str, text: str, window: int, block_words: int) -> Iterator[TestBlock]:
    """The items in blocks of about ``block_words`` words; the driver holds one block at a time."""
    held, n = [], 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text).alias("t")).filter("t is not null")
    for r in rows.toLocalIterator():
        ws = words_of(r.t.encode())
        if ws:
            held.append((r.i, ws))
            n += len(ws)
        if n >= block_words:
            yield TestBlock(held, window)
            held, n = [], 0
    if held:
        yield TestBlock(held, window)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def segment_of(batch: pa.RecordBatch, k: int) -> Segment:
    return read_segment({n: batch.column(n)[k].as_py() for n in ("lengths", "terms", "offsets", "positions")})


def hits_of(seg: Segment, block: TestBlock) -> dict[int, tuple[list[tuple[int, int]], set[str | None]]]:
    """Hit runs of words [start, stop) and items of each document of a segment that has any."""
    start, w = phrase_matches(seg, block)
    found: dict[int, tuple[list[tuple[int, int]], set[str | None]]] = {}
    if len(start):
        step = np.zeros(seg.span, np.int32)
        np.add.at(step, start, 1)
        np.add.at(step, start + block.lengths[w], -1)
        hit = np.cumsum(step) > 0
        doc = seg.document(start)
        for d, x in np.unique(np.stack([doc, w]), axis=1).T.tolist():
            if d not in found:
                a = seg.starts[d]
                found[d] = (_runs(hit[a : a + seg.lengths[d]]), set())
            found[d][1].update(block.items[x])
    return found


def search(index: DataFrame, block: TestBlock, only_hits: bool = False) -> DataFrame:
    """Per document (with ``only_hits``: that has any): its place in the index, id, n_words, hit runs of words [start, stop) and the items found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, seg = batch.column("ids")[k].values, segment_of(batch, k)
                found = hits_of(seg, block)
                places = sorted(found) if only_hits else range(len(ids))
                none: tuple[list, set] = ([], set())
                own = [found.get(p, none) for p in places]
                at = np.array(places, np.int64)
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(at), batch.column("segment")[k].as_py(), np.int64)), pa.array(at), ids.take(pa.array(at)), pa.array(seg.lengths[at]),
                        pa.array([[{"start": a, "stop": b} for a, b in runs] for runs, _ in own], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                        pa.array([sorted_items(x) for _, x in own], pa.list_(pa.string())),
                    ],
                    names=["segment", "place", "id", "n_words", "spans", "items"],
                )

    kind = index.schema["ids"].dataType.elementType.simpleString()
    return index.select("segment", "ids", "lengths", "terms", "offsets", "positions").mapInArrow(run, f"segment bigint, place bigint, id {kind}, n_words bigint, spans {SPANS}, items array<string>")


def search_near(index: DataFrame, phrase: str, slop: int) -> DataFrame:
    """Documents of a stored index with all words of ``phrase`` within ``slop`` + 1 words: segment, place, id and the ``positions`` of :func:`proximity_matches` as word numbers."""
    terms = words_of(phrase.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one, seg = batch.slice(k, 1), segment_of(batch, k)
                at = proximity_matches(seg, terms, slop)
                doc = seg.document(at)
                place, first = np.unique(doc, return_index=True)
                words = np.split(at - seg.starts[doc], first[1:]) if len(place) else []
                yield pa.record_batch(
                    [pa.array(np.full(len(place), one.column(0)[0].as_py(), np.int64)), pa.array(place, pa.int64()), one.column(1)[0].values.take(pa.array(place, pa.int64())), pa.array(words, pa.list_(pa.int64()))],
                    names=["segment", "place", "id", "positions"],
                )

    kind = index.schema["ids"].dataType.elementType.simpleString()
    return index.mapInArrow(run, f"segment bigint, place bigint, id {kind}, positions array<bigint>")


def _all_blocks(index: DataFrame, benchmark: DataFrame, id_col: str, text: str, window: int, block_words: int) -> tuple[TestBlock | None, DataFrame | None]:
    """The only block of a benchmark, or else the merged hits of all its blocks (rows of :func:`search`).

    Each of several blocks is searched for and its hits are written before the next one
    is read, so the driver never holds two.
    """
    blocks = test_blocks(benchmark, id_col, text, window, block_words)
    block, following = next(blocks, TestBlock([], window)), next(blocks, None)
    if following is None:
        return block, None
    parts = [store(search(index, block, True), "hits")]
    while following is not None:
        block, following = following, None
        parts.append(store(search(index, block, True), "hits"))
        following = next(blocks, None)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    once = every.groupBy("segment", "place").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    last = lambda acc: F.element_at(acc, -1)
    joined = F.aggregate(
        "spans", F.array().cast(SPANS),
        lambda acc, s: F.when((F.size(acc) > 0) & (last(acc)["stop"] >= s["start"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["stop"], s["stop"]).alias("stop"))))).otherwise(F.concat(acc, F.array(s))),
    )
    return None, once.withColumn("spans", joined)


SPANS = "array<struct<start:bigint,stop:bigint>>"


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, block_words: int = 500_000, segment_bytes: int = 6 << 20) -> DataFrame:
    """Per document: id, n_words, n_hit, items (ids as sorted strings), spans (runs of hit words)."""
    index = build_index(docs, id_col, text, segment_bytes)
    block, merged = _all_blocks(index, benchmark, item_col, item_text, window, block_words)
    if block is not None:
        found = search(index, block)
    else:
        every = search(index, TestBlock([], window)).drop("spans", "items")
        found = every.join(merged.select("segment", "place", "spans", "items"), ["segment", "place"], "left").withColumns({"spans": F.coalesce("spans", F.array().cast(SPANS)), "items": F.coalesce("items", F.array().cast("array<string>"))})
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])
    return found.select("id", "n_words", n_hit.alias("n_hit"), "items", "spans")


def contaminated(n_hit, n_words):
    """A twentieth of the words or more are hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def leaves(runs: list[tuple[int, int]], n_words: int, window: int) -> bool:
    """A document is turned away for a run of a whole window, however long it is, or for a twentieth of its words (items shorter than a window)."""
    n_hit = sum(b - a for a, b in runs)
    return any(b - a >= window for a, b in runs) or 0 < n_words <= 20 * n_hit


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, block_words: int = 500_000, segment_bytes: int = 6 << 20) -> DataFrame:
    """The rows of ``docs`` that do not leave by :func:`leaves`, columns unchanged.

    The index keeps the rows by segment, so each row is judged by its own text, rows
    without id and repeated rows too, and no text is shuffled.
    """
    index = build_index(docs, id_col, text, segment_bytes, with_rows=True)
    block, merged = _all_blocks(index, benchmark, item_col, item_text, window, block_words)
    held = index
    if merged is not None:
        long_run = F.exists("spans", lambda s: s["stop"] - s["start"] >= window)
        n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])
        gone = merged.filter(long_run | contaminated(n_hit, F.col("n_words"))).groupBy("segment").agg(F.collect_list("place").alias("gone"))  # of one segment
        held = index.join(gone, "segment", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                if block is not None:
                    seg = segment_of(batch, k)
                    gone = [p for p, (runs, _) in hits_of(seg, block).items() if leaves(runs, int(seg.lengths[p]), window)]
                    del seg
                else:
                    gone = batch.column("gone")[k].as_py() or []
                keep = np.ones(len(batch.column("ids")[k].values), bool)
                keep[np.array(gone, np.int64)] = False
                at = 0
                for rows in from_stream(batch.column("stored")[k].as_buffer()):
                    yield pa.RecordBatch.from_arrays(rows.filter(pa.array(keep[at : at + len(rows)])).flatten(), names=[f.name for f in rows.type])
                    at += len(rows)
                give_back()

    return held.mapInArrow(run, docs.schema)
