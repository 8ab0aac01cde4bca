"""Corpus scoring with a unigram base and a gated recurrent language model.

1. Texts become chunks: words numbered by the chunk's own dictionary.
2. Every chunk sends its dictionary with training counts to buckets by word hash;
   buckets add up all chunks' counts and send each chunk the counts of its words.
   Counts thus cover all training documents, and no list of words is in one place.
3. The ``vocabulary`` most frequent words are the model's; any other word is UNKNOWN
   times its smoothed share of the words outside the vocabulary.
4. Training passes over every training document once (a small corpus several times), in ``rounds``: in a round all
   tasks start from the same parameters, learn from their chunks, and the parameters
   are averaged by tokens, in slices.
5. Every document is scored as a whole, its state carried across windows.

Words are told apart by their 64-bit XXH64. Defined results: a null or empty text is
one end token; repeated rows are scored each; a null id belongs to no fold and is
learned from; with nothing to learn from, all words are unseen; an empty table gives
an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.recurrent import END, UNKNOWN, GatedModel
from corvane.llm.scratch import drop, store

_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_END_WORD = b"\n"  # no word has white space in it


def pieces(raw: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """A text in stretches of about ``size`` bytes that cut no word."""
    at = 0
    while at < len(raw):
        stop = at + size
        if stop < len(raw):
            m = _SPACE.search(raw, stop)
            stop = m.start() if m else len(raw)
        yield raw[at:stop]
        at = stop


def squeeze(values: np.ndarray) -> bytes:
    """An array's bytes, their number first, compressed."""
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unsqueeze(packed: bytes, kind: str) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    return np.frombuffer(pa.decompress(packed[8:], decompressed_size=n, codec="zstd", asbytes=True) if n else b"", kind)


def encode_chunks(docs: DataFrame, id_col: str, text: str, train: str, chunk_tokens: int) -> DataFrame:
    """Chunks: chunk, ids, sizes (tokens with the end), learn (documents to learn from), words (hashes), counts (in them), tokens (numbers in words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        number, kind = TaskContext.get().partitionId() << 32, pa.int64()
        known: dict[bytes, int] = {_END_WORD: 0}
        ids, learn, held, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            flat = np.concatenate(held)
            sizes = np.array([len(x) for x in held], np.int64)
            counts = np.bincount(flat[np.repeat(np.array(learn, bool), sizes)], minlength=len(known))
            words = np.fromiter((xxh64_intdigest(w) for w in known), np.uint64, len(known))
            return pa.record_batch(
                [pa.array([number], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([sizes.tolist()], pa.list_(pa.int64())), pa.array([learn], pa.list_(pa.bool_())), pa.array([words.tobytes()], pa.binary()), pa.array([squeeze(counts.astype("<i8"))], pa.binary()), pa.array([squeeze(flat.astype("<u4"))], pa.binary())],
                names=["chunk", "ids", "sizes", "learn", "words", "counts", "tokens"],
            )

        for batch in batches:
            kind = batch.column(0).type
            for key, t, use in zip(batch.column(0), batch.column(1).cast(pa.large_binary()), batch.column(2).to_pylist(), strict=True):
                parts = [np.array([known.setdefault(w, len(known)) for w in p.lower().split()], np.uint32) for p in pieces(t.as_py() or b"")]
                held.append(np.concatenate([*parts, np.zeros(1, np.uint32)]))
                ids.append(key.as_py())
                learn.append(bool(use))
                size += len(held[-1])
                if size >= chunk_tokens:
                    yield row()
                    number, known, ids, learn, held, size = number + 1, {_END_WORD: 0}, [], [], [], 0
        if ids:
            yield row()

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col), F.col(text), F.col(train))
    return store(picked.mapInArrow(run, f"chunk bigint, ids array<{kind}>, sizes array<bigint>, learn array<boolean>, words binary, counts binary, tokens binary"), "encoded")


def count_words(chunks: DataFrame, parts: int, vocabulary: int) -> DataFrame:
    """Rows (chunk, bucket, words, counts): the corpus counts of a chunk's words in a bucket, in the chunk's order.

    Rows of chunk -1 hold a bucket's most frequent words, rows of chunk -2 its sum and
    number of words.
    """
    best = 4 * -(-vocabulary // parts) + 64

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words, counts = np.frombuffer(batch.column(1)[k].as_py(), "<u8"), unsqueeze(batch.column(2)[k].as_py(), "<i8")
                bucket = (words % np.uint64(parts)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                words, counts, bucket = words[order], counts[order], bucket[order]
                cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                ends = np.r_[cut[1:], len(words)]
                yield pa.record_batch(
                    [pa.array(bucket[cut]), pa.array(np.full(len(cut), batch.column(0)[k].as_py(), np.int64)), pa.array([words[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()), pa.array([squeeze(counts[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary())],
                    names=["bucket", "chunk", "words", "counts"],
                )

    def add_up(bucket: int, held: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        words = np.concatenate([np.frombuffer(w, "<u8") for _, w, _ in held])
        counts = np.concatenate([unsqueeze(c, "<i8") for _, _, c in held])
        values, back = np.unique(words, return_inverse=True)
        total = np.zeros(len(values), np.int64)
        np.add.at(total, back, counts)
        sums, at, rows = total[back], 0, []
        for chunk, w, _ in held:
            n = len(w) // 8
            rows.append((chunk, b"", squeeze(sums[at : at + n])))
            at += n
        top = np.lexsort((values, -total))[:best]
        top = top[total[top] > 0]
        rows.append((-1, values[top].tobytes(), squeeze(total[top])))
        rows.append((-2, b"", squeeze(np.array([total.sum(), (total > 0).sum()], "<i8"))))
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["chunk", "bucket", "words", "counts"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for b, *row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held and b != now:
                    yield add_up(now, held)
                    held = []
                now = b
                held.append(tuple(row))
        if held:
            yield add_up(now, held)

    sent = chunks.select("chunk", "words", "counts").mapInArrow(send, "bucket bigint, chunk bigint, words binary, counts binary")
    return store(sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(gather, "chunk bigint, bucket bigint, words binary, counts binary"), "counts")


def gather_model(counted: DataFrame, vocabulary: int) -> dict:
    """What all scores need: N, V, the model's words by falling count and the sums outside of them."""
    n = v = 0
    for r in counted.filter("chunk = -2").select("counts").toLocalIterator():
        a, b = unsqueeze(r.counts, "<i8").tolist()
        n, v = n + a, v + b
    words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for r in counted.filter("chunk = -1").select("words", "counts").toLocalIterator():
        words, counts = np.concatenate([words, np.frombuffer(r.words, "<u8")]), np.concatenate([counts, unsqueeze(r.counts, "<i8")])
        if len(words) > 8 * vocabulary:
            top = np.lexsort((words, -counts))[: vocabulary + 1]
            words, counts = words[top], counts[top]
    from xxhash import xxh64_intdigest

    end = xxh64_intdigest(_END_WORD)
    ends = int(counts[words == end].sum())
    own = words != end
    words, counts = words[own], counts[own]
    top = np.lexsort((words, -counts))[:vocabulary]
    words, counts = words[top], counts[top]
    outside = n - ends - int(counts.sum()), v - (ends > 0) - len(words)
    return {"n": n, "v": v, "end": end, "words": words, "counts": np.concatenate([[ends, outside[0]], counts]).astype(np.float64), "outside": outside}


def to_vocabulary(chunks: DataFrame, counted: DataFrame, gathered: dict, parts: int) -> DataFrame:
    """Chunks in the model's words: chunk, ids, sizes, learn, known, base, rest (log10 of unknown words' shares), stream."""
    n, v, out_n, out_v = gathered["n"], gathered["v"], *gathered["outside"]
    order = np.argsort(gathered["words"])
    ranked, number = gathered["words"][order], (order + 2).astype(np.uint32)
    end = np.uint64(gathered["end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("words", "tokens", "back")}
                words, tokens = np.frombuffer(row["words"], "<u8"), unsqueeze(row["tokens"], "<u4")
                c = np.empty(len(words), np.int64)
                found = [unsqueeze(x["counts"], "<i8") for x in sorted(row["back"], key=lambda x: x["bucket"])]
                c[np.argsort((words % np.uint64(parts)).astype(np.int64), kind="stable")] = np.concatenate(found)
                sizes = batch.column("sizes")[k].values.to_numpy(zero_copy_only=False)
                first = np.cumsum(sizes) - sizes
                at = np.minimum(np.searchsorted(ranked, words), max(len(ranked) - 1, 0))
                ids = np.where(ranked[at] == words, number[at], UNKNOWN) if len(ranked) else np.full(len(words), UNKNOWN)
                ids[words == end] = END
                base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
                rest = np.where(ids == UNKNOWN, np.log10((c + 0.5) / (out_n + 0.5 * (out_v + 1))), 0.0)
                sums = [np.add.reduceat(x[tokens], first) for x in ((c > 0).astype(np.int64), base, rest)]
                one = batch.slice(k, 1)
                yield pa.record_batch(
                    [one.column("chunk"), one.column("ids"), one.column("sizes"), one.column("learn"), *[pa.array([s], pa.list_(t)) for s, t in zip(sums, (pa.int64(), pa.float64(), pa.float64()), strict=True)], pa.array([squeeze(ids.astype("<u2")[tokens])], pa.binary())],
                    names=["chunk", "ids", "sizes", "learn", "known", "base", "rest", "stream"],
                )

    kind = chunks.schema["ids"].dataType.simpleString()
    back = counted.filter("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "counts")).alias("back"))
    joined = chunks.select("chunk", "ids", "sizes", "learn", "words", "tokens").join(back, "chunk")
    return store(joined.mapInArrow(run, f"chunk bigint, ids {kind}, sizes array<bigint>, learn array<boolean>, known array<bigint>, base array<double>, rest array<double>, stream binary"), "streams")


def _docs_of(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    stream = unsqueeze(batch.column("stream")[k].as_py(), "<u2").astype(np.int64)
    sizes = batch.column("sizes")[k].values.to_numpy(zero_copy_only=False)
    return np.split(stream, np.cumsum(sizes)[:-1])


def lanes_for(tokens: int) -> int:
    """Documents side by side: as many as leave some hundred windows in a pool, 8 to 512."""
    return max(8, min(512, tokens // 2048))


def train_round(streams: DataFrame, model: GatedModel, rate: float, pool_tokens: int, passes: int = 1, slice_bytes: int = 1 << 18) -> GatedModel:
    """The model after all ``streams`` have been learned from (each pool ``passes`` times), side by side, and averaged by tokens."""
    spark = streams.sparkSession
    sent = spark.sparkContext.broadcast((model.p, model.first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = GatedModel({k: v.copy() for k, v in sent.value[0].items()}, sent.value[1])
        pool, size, seen = [], 0, 0
        for batch in batches:
            for k in range(batch.num_rows):
                for d, use in zip(_docs_of(batch, k), batch.column("learn")[k].as_py(), strict=True):
                    if use:
                        pool.append(d)
                        size += len(d)
                if size >= pool_tokens:
                    for _ in range(passes):
                        own.learn(pool, rate, lanes_for(size))
                    pool, size, seen = [], 0, seen + size
        for _ in range(passes if pool else 0):
            own.learn(pool, rate, lanes_for(size))
        if seen + size:
            raw, source = own.pack(), TaskContext.get().partitionId()
            cuts = range(0, len(raw), slice_bytes)
            yield pa.record_batch([pa.array(list(cuts), pa.int64()), pa.array([source] * len(cuts), pa.int64()), pa.array([seen + size] * len(cuts), pa.int64()), pa.array([raw[a : a + slice_bytes] for a in cuts], pa.binary())], names=["slice", "source", "tokens", "raw"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, weight = None, None, 0
        for batch in batches:
            for at, tokens, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                part = np.frombuffer(raw, "<f4").astype(np.float64) * tokens
                if at != now:
                    if now is not None:
                        yield pa.record_batch([pa.array([now]), pa.array([(total / weight).astype("<f4").tobytes()], pa.binary())], names=["slice", "raw"])
                    now, total, weight = at, part, tokens
                else:
                    total, weight = total + part, weight + tokens
        if now is not None:
            yield pa.record_batch([pa.array([now]), pa.array([(total / weight).astype("<f4").tobytes()], pa.binary())], names=["slice", "raw"])

    learned = streams.select("sizes", "learn", "stream").mapInArrow(run, "slice bigint, source bigint, tokens bigint, raw binary")
    rows = learned.repartition("slice").sortWithinPartitions("slice", "source").mapInArrow(mean, "slice bigint, raw binary").collect()  # one model
    sent.destroy()
    return model.unpacked(b"".join(r.raw for r in sorted(rows, key=lambda r: r.slice))) if rows else model


def score_corpus(
    docs: DataFrame, train: str, id_col: str = "doc_id", text: str = "text", vocabulary: int = 8190, hidden: int = 16, n_classes: int = 64, rounds: int = 3, rate: float = 0.1, seed: int = 5, chunk_tokens: int = 500_000, pool_tokens: int = 1_000_000, least_tokens: int = 3_000_000, most_passes: int = 8
) -> DataFrame:
    """Per document: id, n_tokens, n_known, train_tokens, base_score and score (log10); ``train`` names a Boolean column.

    A corpus of less than ``least_tokens`` is learned from several times, until that many
    have been seen, ``most_passes`` times at most; a larger one once.
    """
    spark = docs.sparkSession
    if vocabulary + 2 > 65_536:
        raise ValueError("the vocabulary's numbers have 16 bits")
    encoded = encode_chunks(docs, id_col, text, train, chunk_tokens)
    rows = encoded.select(F.length("words").alias("n")).agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / (16 << 20)))
    counted = count_words(encoded, parts, vocabulary)
    gathered = gather_model(counted, vocabulary)
    streams = to_vocabulary(encoded, counted, gathered, parts)
    drop(encoded, counted)
    model = GatedModel.start(gathered["counts"], hidden, n_classes, seed)
    passes = min(most_passes, math.ceil(least_tokens / max(gathered["n"], 1))) if gathered["n"] < least_tokens else 1
    for r in range(rounds):
        model = train_round(streams.filter(F.pmod(F.xxhash64("chunk"), F.lit(rounds)) == r), model, rate, pool_tokens, passes)
    sent = spark.sparkContext.broadcast((model.p, model.first))
    n = gathered["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = GatedModel(*sent.value)

        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Chunks are scored together, so that their longest documents run side by side."""
            parts = [_docs_of(one, 0) for one in held]
            found = own.score([d for p in parts for d in p]) / math.log(10)
            at = 0
            for one, p in zip(held, parts, strict=True):
                cols = {c: one.column(c)[0].values for c in ("ids", "sizes", "known", "base", "rest")}
                score = found[at : at + len(p)] + cols["rest"].to_numpy(zero_copy_only=False)
                at += len(p)
                yield pa.record_batch([cols["ids"], cols["sizes"], cols["known"], pa.array(np.full(len(score), n, np.int64)), cols["base"], pa.array(score)], names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                held.append(batch.slice(k, 1))
                size += int.from_bytes(batch.column("stream")[k].as_py()[:8], "little") // 2
                if size >= 2 * pool_tokens:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    kind = docs.schema[id_col].dataType.simpleString()
    return streams.select("ids", "sizes", "known", "base", "rest", "stream").mapInArrow(run, f"id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
