"""Token counts of fields and sections by offset-mapped attribution.

Each whole document is encoded once. Its tokens' spans are the offsets of the library,
or follow from the byte lengths of a plain byte-level vocabulary, which loses no byte,
mapped to characters; they are joined to the sections' spans by binary search on the
sections' bounds. A token that crosses a bound is allotted by an explicit rule:

``start``     to the section that holds its first character;
``majority``  to the section that holds most of its bytes, the earlier on a tie.

Every token is allotted exactly once, so a document's sections add up to its
tokens. A character whose bytes are cut between tokens belongs to each of them.

Sections are maximal stretches up to and with a line break, unless spans are
given. Defined results: a null or empty text has no section and no row in the
section table, and 0 tokens in the document table; sections without a token have
0; rows repeat if documents repeat; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.encoding import WholeEncoder, blocks, encoder


def byte_lengths(path: str) -> np.ndarray:
    """Bytes of each id of a byte-level vocabulary."""
    tokenizer = encoder(path).tokenizer
    size = tokenizer.get_vocab_size()
    kept = vars(encoder(path)).setdefault("lengths", None)
    if kept is None:
        kept = np.array([len(tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        encoder(path).lengths = kept
    return kept


def line_sections(text: str) -> np.ndarray:
    """Starts of the stretches that end with a line break, and the end of the text."""
    breaks = [k + 1 for k, c in enumerate(text) if c == "\n"] if "\n" in text else []
    return np.array([0, *[b for b in breaks if b < len(text)], len(text)], np.int64)


def allot(ids: np.ndarray, lengths: np.ndarray, raw: bytes, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section; ``bounds`` are character offsets from 0 to the text's length."""
    data = np.frombuffer(raw, np.uint8)
    chars = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of each character
    cuts = np.append(chars, len(raw))[bounds]
    stop = np.cumsum(lengths[ids])
    start = stop - lengths[ids]
    first = np.searchsorted(cuts, start, "right") - 1
    last = np.searchsorted(cuts, stop - 1, "right") - 1
    own = first.copy()
    cross = np.flatnonzero(first != last)
    if rule == "majority":
        for k in cross.tolist():
            parts = np.minimum(stop[k], cuts[first[k] + 1 : last[k] + 2]) - np.maximum(start[k], cuts[first[k] : last[k] + 1])
            own[k] = first[k] + int(np.argmax(parts))
    elif rule != "start":
        raise ValueError(rule)
    n = len(bounds) - 1
    return np.bincount(own, minlength=n), np.bincount(own[cross], minlength=n)


def allot_spans(found: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """:func:`allot` for the character spans that a library gives; ``majority`` counts characters."""
    start, stop = found[:, 0], np.maximum(found[:, 1], found[:, 0] + 1)
    first = np.minimum(np.searchsorted(bounds, start, "right") - 1, len(bounds) - 2)
    last = np.minimum(np.searchsorted(bounds, stop - 1, "right") - 1, len(bounds) - 2)
    own, cross = first.copy(), np.flatnonzero(first != last)
    if rule == "majority":
        for k in cross.tolist():
            own[k] = first[k] + int(np.argmax(np.minimum(stop[k], bounds[first[k] + 1 : last[k] + 2]) - np.maximum(start[k], bounds[first[k] : last[k] + 1])))
    elif rule != "start":
        raise ValueError(rule)
    n = len(bounds) - 1
    return np.bincount(own, minlength=n), np.bincount(own[cross], minlength=n)


def attributed(vocabulary: str, texts: list[str], bounds: list[np.ndarray], rule: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tokens, crossing tokens) of each text's sections."""
    enc = encoder(vocabulary)
    if isinstance(enc, WholeEncoder):
        yield from (allot_spans(f, b, rule) for f, b in zip(enc.spans(texts), bounds, strict=True))
    else:
        lengths = byte_lengths(vocabulary)
        yield from (allot(ids, lengths, t.encode(), b, rule) for ids, t, b in zip(enc.encode(texts), texts, bounds, strict=True))


def section_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text", rule: str = "majority", sections: Callable[[str], np.ndarray] = line_sections) -> DataFrame:
    """Per document and section: id, section (from 0), start_char, end_char, n_tokens, n_crossing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts):
                out: list[list[np.ndarray]] = [[], [], [], [], [], []]
                own = [k for k in range(a, b) if texts[k]]
                cuts = [sections(texts[k]) for k in own]
                for k, bounds, (n, crossing) in zip(own, cuts, attributed(vocabulary, [texts[k] for k in own], cuts, rule), strict=True):
                    for x, v in zip(out, (np.full(len(n), k), np.arange(len(n)), bounds[:-1], bounds[1:], n, crossing), strict=True):
                        x.append(v)
                if out[0]:
                    cols = [np.concatenate(x).astype(np.int64) for x in out]
                    yield pa.record_batch([keys.take(pa.array(cols[0])), *map(pa.array, cols[1:])], names=["id", "section", "start_char", "end_char", "n_tokens", "n_crossing"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text)).mapInArrow(run, f"id {kind}, section bigint, start_char bigint, end_char bigint, n_tokens bigint, n_crossing bigint")


def field_tokens(docs: DataFrame, fields: list[str], vocabulary: str, id_col: str, rule: str = "majority", between: str = "\n") -> DataFrame:
    """Tokens of each field of a row, the fields joined by ``between`` and encoded as one text: id, field, n_tokens, n_crossing.

    A separator counts with the field before it.
    """
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*[[t or "" for t in batch.column(k + 1).to_pylist()] for k in range(len(names))], strict=True))
            texts = [between.join(r) for r in rows]
            for a, b in blocks(texts):
                at, field, count, crossing = [], [], [], []
                cuts = [np.cumsum([0, *[len(v) + len(between) * (j + 1 < len(names)) for j, v in enumerate(rows[k])]]) for k in range(a, b)]
                for k, (n, x) in zip(range(a, b), attributed(vocabulary, texts[a:b], cuts, rule), strict=True):
                    at += [k] * len(names)
                    field += names
                    count += n.tolist()
                    crossing += x.tolist()
                yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(field), pa.array(count, pa.int64()), pa.array(crossing, pa.int64())], names=["id", "field", "n_tokens", "n_crossing"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), *[F.col(f).cast("string") for f in names]).mapInArrow(run, f"id {kind}, field string, n_tokens bigint, n_crossing bigint")
