"""Quality rules as a short-circuit cascade of native expressions.

Each rule is a Boolean Column that rejects a document. A bounded sample gives
each rule's rejection rate and its cost; rules are then ordered by rejection per
cost and evaluated in one ``CASE``, so that later (dearer) rules only run on what
the earlier ones let through. The verdict does not depend on the order.

Defined results: a null text has no words and fails the base rules; an empty
table gives an empty table; repeated rows are judged each on its own; extra
columns pass through :func:`quality_filter` untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; null text has none."""
    body = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(body.isNull() | (body == ""), F.array().cast("array<string>")).otherwise(F.split(body, SPACE))


def word_chars(ws: Column) -> Column:
    return F.length(F.array_join(ws, "")).cast("long")


def symbol_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long")


def lines(text: Column) -> Column:
    """Lines with a word; null text has none."""
    return F.coalesce(F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")), F.array().cast("array<string>"))


def dup_lines(ls: Column) -> Column:
    """Lines that equal an earlier line."""
    return (F.size(ls) - F.size(F.array_distinct(ls))).cast("long")


def repeat_words(ws: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Windows are compared by the 64-bit XXH64 of their words: sort (hash, start)
    pairs, keep the starts whose neighbour has the same hash, and add up the
    union of their three-word spans. Linear memory and n log n time for a text
    of any length.
    """
    return let(ws, _repeat_words)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside nested lambdas the optimizer would repeat it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(ws: Column) -> Column:
    n = F.size(ws)
    hashes = F.slice(F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2))), F.lit(1), n - 2)

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(pairs, spans)

    def spans(s: Column) -> Column:
        starts = F.sort_array(F.array_compact(F.transform(s, lambda e, i: F.when((e["h"] == F.get(s, i - 1)["h"]) | (e["h"] == F.get(s, i + 1)["h"]), e["i"]))))
        return let(starts, total)

    def total(p: Column) -> Column:
        gaps = F.zip_with(F.slice(p, F.lit(2), F.size(p) - 1), F.slice(p, F.lit(1), F.size(p) - 1), lambda b, a: F.least(b - a, F.lit(3)))
        return F.when(F.size(p) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda acc, g: acc + g))

    def once(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))

    return F.when(n < 4, F.lit(0)).otherwise(let(hashes, once)).cast("long")


@dataclass(frozen=True)
class Rule:
    """``reject`` is true for a document that the rule turns away."""

    name: str
    reject: Column


BASE = ("too_few_words", "repeated_windows")


def measures(text: Column, ws: Column) -> dict[str, Column]:
    """What rules are made of, as expressions over a text and the array of its words: computed where a rule asks for it."""
    ls = lines(text)
    return {
        "n_words": F.size(ws).cast("long"), "word_chars": word_chars(ws), "n_symbols": symbol_count(text), "n_dup_lines": dup_lines(ls), "n_lines": F.size(ls).cast("long"),
        "n_repeat_words": repeat_words(ws), "n_upper": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long"),
    }


def default_rules(m: dict[str, Column]) -> list[Rule]:
    """Base rules and conservative verdict rules over :func:`measures`, or columns that hold them."""
    n = m["n_words"]
    return [
        Rule("too_few_words", n < 50),
        Rule("repeated_windows", m["n_repeat_words"] * 100 > n * 50),
        Rule("symbol_heavy", m["n_symbols"] * 10 > n * 3),
        Rule("shouting", m["n_upper"] * 2 > m["word_chars"]),
        Rule("repeated_lines", m["n_dup_lines"] * 10 > m["n_lines"] * 4),
        Rule("odd_word_length", (m["word_chars"] > n * 15) | (m["word_chars"] < n * 2)),
    ]


def rule_costs(docs: DataFrame, rules: Callable[[dict[str, Column]], Sequence[Rule]] = default_rules, text: str = "text", sample_rows: int = 500, seed: int = 7, times: int = 20, tries: int = 3) -> list[tuple[str, float, float]]:
    """(name, rejected share, seconds a document) of each rule on about ``sample_rows`` documents of the whole table.

    A Bernoulli sample at the rate that gives ``sample_rows`` of the counted rows; it
    stays where it is read and nothing is shuffled. Each rule runs alone over the cached
    sample, ``times`` times a document; of ``tries`` runs the quickest counts, less what
    reading the sample takes without a rule.
    """
    rate = min(1.0, sample_rows / max(docs.count(), 1))
    sample = docs.select(F.col(text).alias("text")).sample(rate, seed).withColumn("words", words(F.col("text"))).persist()
    try:
        total = max(sample.count(), 1)
        often = sample.select("text", "words", F.explode(F.sequence(F.lit(1), F.lit(times))))

        def run(reject: Column) -> tuple[int, float]:
            took, hits = [], 0
            for _ in range(tries):
                began = time.perf_counter()
                hits = often.agg(F.count_if(F.coalesce(reject, F.lit(False)))).first()[0]
                took.append(time.perf_counter() - began)
            return hits // times, min(took)

        idle = run(F.length("text") < 0)[1]
        return [(r.name, (n := run(r.reject))[0] / total, max(n[1] - idle, 1e-4) / total / times) for r in rules(measures(F.col("text"), F.col("words")))]
    finally:
        sample.unpersist()


def order_rules(docs: DataFrame, rules: Callable[[dict[str, Column]], Sequence[Rule]] = default_rules, text: str = "text", sample_rows: int = 500, seed: int = 7) -> list[str]:
    """Names of ``rules`` by falling rejection per cost on a sample, which sets the order of evaluation and never a verdict."""
    scored = rule_costs(docs, rules, text, sample_rows, seed)
    return [name for name, _, _ in sorted(scored, key=lambda x: -(x[1] + 1e-3) / x[2])]


def verdict(rules: Sequence[Rule]) -> Column:
    """True where no rule rejects; one CASE that stops at the first rejection."""
    case = None
    for rule in rules:
        hit = F.coalesce(rule.reject, F.lit(False))
        case = F.when(hit, F.lit(False)) if case is None else case.when(hit, F.lit(False))
    return F.lit(True) if case is None else case.otherwise(F.lit(True))


def quality_filter(docs: DataFrame, text: str = "text", sample_rows: int = 500) -> DataFrame:
    """The rows of ``docs`` that every rule lets through, columns unchanged."""
    order = order_rules(docs, text=text, sample_rows=sample_rows)
    t = F.col(text)
    return docs.filter(let(words(t), lambda w: verdict(sorted(default_rules(measures(t, w)), key=lambda r: order.index(r.name)))))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sample_rows: int = 500) -> DataFrame:
    """Per document the base measures, ``base_failed`` and the cascade's verdict ``kept``.

    The measures are computed once and the rules read them; only the capitals are left
    to the cascade, behind the base rules.
    """
    order = order_rules(docs, text=text, sample_rows=sample_rows)
    t = F.col("t")
    split = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t"), words(F.col(text)).alias("w"), lines(F.col(text)).alias("ls"))
    given = measures(t, F.col("w")) | {"n_dup_lines": dup_lines(F.col("ls")), "n_lines": F.size("ls").cast("long")}
    wide = split.select("id", "t", *[v.alias(k) for k, v in given.items() if k != "n_upper"])
    m = {k: F.col(k) for k in given} | {"n_upper": given["n_upper"]}
    base, own = ([r for r in default_rules(m) if (r.name in BASE) == is_base] for is_base in (True, False))
    failed = ~verdict(base)
    kept = F.when(failed, F.lit(False)).otherwise(verdict(sorted(own, key=lambda r: order.index(r.name))))
    return wide.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"))
