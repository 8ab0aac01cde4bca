"""Language identification of mixed-language text.

A word's script narrows the candidate languages to those whose training words use
it. Each word gets a log-probability per candidate from hashed character n-grams;
Viterbi with a penalty for a switch then labels every word, and runs of one label
are the spans. The document's language is the one with most letters in its spans.

The model counts all training rows: a table of languages by n-gram slots. It has
``cells`` cells at most: ``slots`` to a language up to 256 languages, fewer beyond, so
that its size is bounded however large the corpus and however many its languages.

Defined results: null texts and texts without a letter are ``und`` with score 0; so
are all if nothing was learned; a word whose script no language uses narrows
nothing; ties go to the language first in code point order; rows are labelled each
on its own. A word's script is that of its first character; scripts without spaces
give words as long as their sentences. Rows without id are learned from by no fold
of :func:`fold_of` and are never held out.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
#: Script ranges by first code point; what is not listed below belongs to no known script.
RANGES = [
    (0x41, "Latin"), (0x2B0, ""), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x700, ""), (0x750, "Arabic"), (0x780, ""),
    (0x900, "Devanagari"), (0x980, "Bengali"), (0xA00, "Gurmukhi"), (0xA80, "Gujarati"), (0xB00, ""), (0xB80, "Tamil"), (0xC00, "Telugu"), (0xC80, "Kannada"), (0xD00, "Malayalam"), (0xD80, "Sinhala"),
    (0xE00, "Thai"), (0xE80, "Lao"), (0xF00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, ""), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""),
    (0x3040, "Kana"), (0x3100, ""), (0x3400, "Han"), (0xA000, ""), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, ""), (0x20000, "Han"), (0x323B0, ""),
]
_FIRST = np.array([a for a, _ in RANGES])


_SEEDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def scripts_of(words: list[str]) -> np.ndarray:
    """Number of the range of each word's first character; 0 below all ranges."""
    return np.searchsorted(_FIRST, np.fromiter((ord(w[0]) for w in words), np.int64, len(words)), "right")


def _slots(h: np.ndarray, slots: int) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * _SEEDS[1]
    return ((h ^ (h >> np.uint64(32))) % np.uint64(slots)).astype(np.int64)


def grams(words: list[str], slots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots of the n-grams (1 to 4 characters and the whole word) of words with their ends marked.

    One pair for each kind: slots word after word, and how many each word has.
    """
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    stop = np.cumsum(size)
    left = np.repeat(stop, size) - np.arange(len(codes))  # characters from here to the word's end
    out, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, 5):
        h = h[: len(codes) - n + 1] * _SEEDS[0] + codes[n - 1 :] * _SEEDS[n]
        use = left[: len(h)] >= n
        out.append((_slots(h[use], slots), np.maximum(size - n + 1, 0)))
    place = np.arange(len(codes)) - np.repeat(stop - size, size)
    powers = np.cumprod(np.r_[np.uint64(1), np.full(int(size.max()), _SEEDS[3])]) if len(words) else np.zeros(0, np.uint64)
    whole = np.add.reduceat(codes * powers[place], stop - size) if len(words) else np.zeros(0, np.uint64)
    out.append((_slots(whole * _SEEDS[2], slots), np.ones(len(words), np.int64)))
    return out


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    found = WORD.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())
    return [w for w in found if w.isalpha() or any(c.isalpha() for c in w)]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", slots: int = 1 << 15, cells: int = 1 << 23, room: int = 200_000) -> dict:
    """The model of all rows of ``docs`` with a text and a language."""
    labelled = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text), F.col(lang).cast("string"))
    while slots > 256 and slots * labelled.select(lang).distinct().limit(cells // 256).count() > cells:
        slots //= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(slots + 1, np.int64))
        scripts: Counter = Counter()
        seen: dict[str, Counter] = defaultdict(Counter)

        def flush() -> None:
            for code, counted in seen.items():
                names, times = list(counted), np.fromiter(counted.values(), np.int64, len(counted))
                for at in range(0, len(names), 1 << 14):
                    part, n = names[at : at + (1 << 14)], times[at : at + (1 << 14)]
                    for found, per in grams(part, slots):
                        np.add.at(total[code], found, np.repeat(n, per))
                    total[code][slots] += int(n.sum())
                    for s, k in zip(scripts_of(part).tolist(), n.tolist(), strict=True):
                        scripts[code, RANGES[s - 1][1] if s else ""] += k
            seen.clear()

        for batch in batches:
            for t, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[code].update(words_of(t))
                if len(seen[code]) > room:
                    flush()
        flush()
        for code, v in total.items():
            at = np.flatnonzero(v)
            yield pa.record_batch([pa.array([code] * len(at)), pa.array(at.astype(np.int64)), pa.array(v[at])], names=["lang", "slot", "n"])
        if scripts:
            yield pa.record_batch([pa.array([f"{c}\t{s}" for c, s in scripts]), pa.array([-1] * len(scripts), pa.int64()), pa.array(list(scripts.values()), pa.int64())], names=["lang", "slot", "n"])

    rows = labelled.mapInArrow(run, "lang string, slot bigint, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    counts = rows[rows.slot >= 0]
    codes = sorted(set(counts.lang), key=lambda s: s.encode())
    table = np.zeros((slots + 1, len(codes)), np.float64)
    at = {c: k for k, c in enumerate(codes)}
    table[counts.slot.to_numpy(), [at[c] for c in counts.lang]] = counts.n
    seen = table[:-1]
    logp = (np.log(seen + 0.5) - np.log(seen.sum(axis=0) + 0.5 * slots)).astype(np.float32)
    use: dict[str, np.ndarray] = {}
    for key, n in zip(rows.lang[rows.slot < 0], rows.n[rows.slot < 0], strict=True):
        code, s = key.rsplit("\t", 1)
        if n >= 0.001 * table[slots, at[code]]:
            use.setdefault(s, np.zeros(len(codes), bool))[at[code]] = True
    return {"codes": codes, "logp": logp, "scripts": use, "slots": slots}


class Scorer(dict):
    """Words to rows of ``table``; scores are kept while there is room."""

    def __init__(self, model: dict, room: int = 300_000):
        k = len(model["codes"])
        self.model, self.room, self.fresh = model, min(room, (1 << 24) // max(k, 1)), []
        self.may = np.array([model["scripts"].get(name, np.ones(k, bool)) for _, name in [(0, ""), *RANGES]]).reshape(len(RANGES) + 1, k)
        self.table = np.zeros((0, k), np.float32)

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n

    def score(self, words: list[str]) -> np.ndarray:
        logp = self.model["logp"]
        sums, count = np.zeros((len(words), logp.shape[1]), np.float64), np.zeros(len(words), np.int64)
        for found, per in grams(words, self.model["slots"]):
            has = np.flatnonzero(per)
            if len(has):
                sums[has] += np.add.reduceat(logp[found], (np.cumsum(per) - per)[has], axis=0)
                count += per
        rows = sums / count[:, None] * np.minimum(np.fromiter(map(len, words), np.int64, len(words)), 8)[:, None]
        return np.where(self.may[scripts_of(words)], rows, rows.min(axis=1, keepdims=True) - 50.0).astype(np.float32)

    def lookup(self, words: list[str]) -> np.ndarray:
        """Rows of the words' scores in ``table``."""
        if len(self) > self.room:
            self.clear()
            self.table = self.table[:0]
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        fresh, self.fresh = self.fresh, []
        if fresh:
            self.table = np.concatenate([self.table, *[self.score(fresh[k : k + 4096]) for k in range(0, len(fresh), 4096)]])
        return at


def one_language(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Label of each text that has one best label throughout; -1 where the best path may switch.

    Each stretch of another label gains at most the highest sum that any stretch has
    over the text's best label. A path of j such stretches, j > 1 if it never has that
    label, pays j - 1 switches at least and j if it has: with all sums below half the
    penalty the best label alone is best.
    """
    first = np.cumsum(lengths) - lengths
    label = np.add.reduceat(scores, first, axis=0, dtype=np.float64).argmax(axis=1)
    text = np.repeat(np.arange(len(lengths)), lengths)
    own = scores[np.arange(len(scores)), label[text]].astype(np.float64)
    best = np.zeros(len(lengths))
    apart = 1e5 * (1 + float(np.abs(scores).max()))  # more than a stretch can sum to in 1e5 words; see below
    for k in range(scores.shape[1]):
        c = np.cumsum(scores[:, k] - own)
        before = np.r_[0.0, c[:-1]]
        base = before - before[first][text] - apart * text
        low = np.minimum.accumulate(base) + apart * text
        best = np.maximum(best, np.maximum.reduceat(c - before[first][text] - low, first))
    return np.where((best < switch / 2 - 1e-3) & (lengths < 100_000), label, -1)


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Best label of each word; ``scores`` holds the texts one after another, longest text first."""
    starts = np.cumsum(lengths) - lengths
    n, k = scores.shape
    back = np.zeros((n, k), np.uint8 if k < 256 else np.uint16)
    state = scores[starts].astype(np.float64)
    active = len(lengths)
    last = state.copy()
    for t in range(1, int(lengths[0])):
        while lengths[active - 1] <= t:
            active -= 1
        now = state[:active]
        best = now.argmax(axis=1)
        jump = now[np.arange(active), best] - switch
        stay = now >= jump[:, None]
        at = starts[:active] + t
        back[at] = np.where(stay, np.arange(k), best[:, None])
        state[:active] = np.where(stay, now, jump[:, None]) + scores[at]
        last[:active] = state[:active]
    out = np.zeros(n, np.int64)
    label = last.argmax(axis=1)
    for t in range(int(lengths[0]) - 1, -1, -1):
        live = int(np.searchsorted(-lengths, -t, "left"))  # texts longer than t
        at = starts[:live] + t
        out[at] = label[:live]
        label[:live] = back[at, label[:live]]
    return out


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text: str = "text", switch: float = 6.0, words_at_once: int = 1 << 18) -> DataFrame:
    """Per document: id, lang_pred, score (share of letters in spans of that language) and spans (lang, first word, words)."""
    codes = model["codes"]
    words_at_once = max(1, min(words_at_once, (1 << 23) // max(len(codes), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)

        def label(part: list[list[str]]) -> list[tuple[str, float, list[dict]]]:
            out: list[tuple[str, float, list[dict]]] = [("und", 0.0, [])] * len(part)
            order = [k for k in sorted(range(len(part)), key=lambda k: -len(part[k])) if part[k]]
            if not order or not codes:
                return out
            flat = scorer.lookup([w for k in order for w in part[k]])
            sizes = np.array([len(part[k]) for k in order], np.int64)
            scores = scorer.table[flat]
            alone = one_language(scores, sizes, switch)
            labels = np.repeat(alone, sizes)
            mixed = labels < 0
            if mixed.any():
                labels[mixed] = viterbi(scores[mixed], sizes[alone < 0], switch)
            letters = np.array([len(w) for k in order for w in part[k]], np.int64)
            at = 0
            for k, n in zip(order, sizes.tolist(), strict=True):
                own, w = labels[at : at + n], letters[at : at + n]
                share = np.bincount(own, weights=w, minlength=len(codes))
                best = int(share.argmax())
                cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True])
                spans = [{"lang": codes[own[a]], "first": int(a), "words": int(b - a)} for a, b in zip(cut[:-1], cut[1:], strict=True)]
                out[k] = (codes[best], float(share[best] / share.sum()), spans)
                at += n
            return out

        for batch in batches:
            found, part, size = [], [], 0
            for t in batch.column(1).to_pylist():
                part.append(words_of(t))
                size += len(part[-1])
                if size >= words_at_once:
                    found += label(part)
                    part, size = [], 0
            found += label(part)
            yield pa.record_batch(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64())])))],
                names=["id", "lang_pred", "score", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text)).mapInArrow(run, f"id {kind}, lang_pred string, score double, spans array<struct<lang:string,first:bigint,words:bigint>>")


def fold_of(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds
