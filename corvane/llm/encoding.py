"""Whole-text encoding with a byte-level BPE of the tokenizers library.

A byte-level BPE never joins bytes across the boundaries of its word pattern. A
run of non-space characters with at most one space before it, and each run of
white space as the pattern cuts it, are thus encoded alike alone and in a text:
pieces are encoded once by the library and then looked up. Files of other kinds are
encoded text by text.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np

from corvane.llm.scratch import give_back

SPACES = "\t-\r \x85\xa0  -     　"
#: A run of letters that every version of the word pattern knows is a unit of it if a white space follows, or one stop and
#: then a white space; the stop is a unit too. A unit needs the merges only. All else is encoded in longer pieces.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
UNIT = re.compile(f" ?[{LETTERS}]+")
END = rf"(?=[{SPACES}]|\Z)"
PIECE = re.compile(rf" ?[{LETTERS}]+(?=[.,]?(?:[{SPACES}]|\Z))|[.,]{END}| ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


class _Numbers(dict):
    """Pieces to numbers; a new piece gets the next one and is noted as fresh."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.fresh.append(piece)
        return n


class PieceEncoder:
    """Texts to ids; the pieces seen are kept until they are more than ``room`` or have more than ``room_chars`` characters."""

    def __init__(self, path: str, room: int = 1_000_000, room_chars: int = 24_000_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = Split("\n", "removed")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.room, self.room_chars = room, room_chars
        self.clear()

    def clear(self) -> None:
        self.number, self.chars = _Numbers(), 0
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.uses = np.zeros(1 << 14, np.int64)

    def _units(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single units and how many each has: the merges over their bytes in the vocabulary's letters, one unit a line."""
        body = "\n".join(pieces)  # no unit has a line break
        shown = body.replace(" ", self.shown[32]) if body.isascii() else body.encode().decode("latin-1").translate(self.shown | {10: "\n"})
        found = self.merges.encode(shown, add_special_tokens=False)
        return np.array(found.ids, np.uint32), np.bincount(np.array(found.word_ids, np.int64), minlength=len(pieces))

    def _whole(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _learn(self, pieces: list[str], first: int) -> None:
        """Ids of new pieces, numbered from ``first``: units by the merges, all else by the whole tokenizer."""
        unit = np.fromiter((UNIT.fullmatch(p) is not None for p in pieces), bool, len(pieces))
        while first + len(pieces) > len(self.begin):
            self.begin, self.size, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size, self.uses))
        for mask, way in ((unit, self._units), (~unit, self._whole)):
            if mask.any():
                ids, sizes = way([p for p, use in zip(pieces, mask.tolist(), strict=True) if use])
                while self.used + len(ids) > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
                at = first + np.flatnonzero(mask)
                self.size[at], self.begin[at] = sizes, self.used + np.cumsum(sizes) - sizes
                self.flat[self.used : self.used + len(ids)] = ids
                self.used += len(ids)
        self.chars += sum(map(len, pieces))

    def trim(self) -> None:
        """Forget the pieces that were met once only; if that leaves more than half, all of them."""
        keep = np.flatnonzero(self.uses[: len(self.number)] > 1)
        names, begin, size = list(self.number), self.begin[keep], self.size[keep]
        ids = self.flat[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
        kept = [names[k] for k in keep.tolist()]
        self.clear()
        if 2 * len(kept) > self.room or 2 * sum(map(len, kept)) > self.room_chars:
            return
        self.number.update(zip(kept, range(len(kept)), strict=True))
        self.flat, self.used, self.chars = ids, len(ids), sum(map(len, kept))
        self.begin, self.size, self.uses = (np.concatenate([x, np.zeros(1 << 14, np.int64)]) for x in (np.cumsum(size) - size, size, np.ones(len(kept), np.int64)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the library gives them for the whole text."""
        if len(self.number) > self.room or self.chars > self.room_chars:
            self.trim()
        look, at = self.number.__getitem__, []
        for t in texts:
            pieces = PIECE.findall(t)
            at.append(np.fromiter(map(look, pieces), np.int32, len(pieces)))
        fresh, self.number.fresh = self.number.fresh, []
        first = len(self.number) - len(fresh)
        for k in range(0, len(fresh), 8192):
            self._learn(fresh[k : k + 8192], first + k)
        flat = np.concatenate(at) if at else np.zeros(0, np.int32)
        np.add.at(self.uses, flat, 1)
        n = self.size[flat]
        stop = np.cumsum(n)
        ids = self.flat[np.repeat(self.begin[flat] - stop + n, n) + np.arange(int(stop[-1]) if len(stop) else 0)]
        ends = np.concatenate([[0], stop])[np.cumsum([len(a) for a in at], dtype=np.int64)]
        return np.split(ids, ends[:-1]) if at else []


class WholeEncoder:
    """Any other tokenizer of the library: whole texts, as it encodes them, and the offsets that it gives."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def spans(self, texts: list[str]) -> list[np.ndarray]:
        """First character and end of each token, by text."""
        return [np.array(e.offsets, np.int64).reshape(-1, 2) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


def by_pieces(path: str) -> bool:
    """Whether a file is a plain byte-level BPE with the usual word pattern, for which pieces may be encoded apart."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    return plain and spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")


def encoder(path: str) -> PieceEncoder | WholeEncoder:
    """One encoder a worker process and file: kept on the library's module, for tasks that follow."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import tokenizers

    kept = vars(tokenizers).setdefault("_corvane_encoders", {})
    if path not in kept:
        kept[path] = PieceEncoder(path) if by_pieces(path) else WholeEncoder(path)
    return kept[path]


def forget() -> None:
    """Drop the encoders that a worker process has kept; a task that needs one again makes it anew."""
    import sys

    if vars(sys.modules.get("tokenizers", sys)).pop("_corvane_encoders", None):
        give_back()


def blocks(texts: list[str], chars: int = 4_000_000):
    """Index ranges of ``texts`` of about ``chars`` characters each."""
    first = size = 0
    for k, t in enumerate(texts):
        size += len(t) + 64
        if size >= chars:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)
