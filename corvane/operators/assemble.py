"""From hits to context: duplicate collapse, neighbors, budgeted packing, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.identity import short_hash
from corvane.functions.text import SPACE_CHARS, safe_score, strip_end


def collapse_equal(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """Hits (qid, id, kind, text, score, rank) with equal kind and text to one: the best score, then the least id.

    Groups are in the order of their best rank; ``equivalents`` are the other ids.
    The text is grouped by its hash and length, so no long text is a shuffle key.
    """
    key = ["qid", "kind", "h", "n"]
    best = F.struct((-safe_score(F.col("score"))).alias("s"), F.col("id").alias("id"))
    rows = hits.withColumn("h", F.sha2(F.col("text").cast("binary"), 256)).withColumn("n", F.length("text"))
    groups = rows.groupBy(*key).agg(F.min(best).alias("best"), F.min("rank").alias("first"), F.array_sort(F.collect_set("id")).alias("ids"))
    w = Window.partitionBy("qid").orderBy("first", "best.id")
    out = groups.select("qid", F.col("best.id").alias("id"), (-F.col("best.s")).alias("score"), F.row_number().over(w).alias("rank"), F.array_except("ids", F.array("best.id")).alias("equivalents"))
    return out if limit is None else out.filter(F.col("rank") <= limit)


def expand_neighbors(hits: DataFrame, chunks: DataFrame, window: int, max_hits: int) -> DataFrame:
    """Hits (qid, document_id, chunk_index, rank) with the chunks around them: before and after, arrays of (chunk_index, text).

    A chunk goes to the best hit that reaches it, once; a hit's own chunk is never
    another's neighbor if that hit ranks first for it.
    """
    reach = hits.filter(F.col("rank") <= max_hits).select("qid", "document_id", F.col("chunk_index").alias("center"), "rank", F.explode(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window)).alias("chunk_index")).filter("chunk_index >= 0")
    first = Window.partitionBy("qid", "document_id", "chunk_index").orderBy("rank")
    claimed = reach.withColumn("_n", F.row_number().over(first)).filter("_n = 1 and chunk_index <> center").drop("_n")
    found = claimed.join(chunks.select("document_id", "chunk_index", "text"), ["document_id", "chunk_index"])
    side = lambda c: F.array_sort(F.collect_list(F.when(c, F.struct("chunk_index", "text"))))
    packed = found.groupBy("qid", "rank").agg(side(F.col("chunk_index") < F.col("center")).alias("before"), side(F.col("chunk_index") > F.col("center")).alias("after"))
    return hits.join(packed, ["qid", "rank"], "left")


def expanded_text(before: Column, body: Column, after: Column, budget: Column, sep: str = "\n\n") -> Column:
    """``body`` with as much of ``before``'s tail and ``after``'s head as fits; a body too long is cut."""
    whole = F.array_join(F.filter(F.array(before, body, after), lambda x: x.isNotNull() & (x != "")), sep)
    short = F.coalesce(before, F.lit(""))
    late = F.coalesce(after, F.lit(""))
    s = len(sep)
    rest = budget - F.length(body)
    both = (short != "") & (late != "")
    room = F.greatest(F.lit(0), rest - 2 * s)
    b0 = F.least(F.length(short), F.floor(room / 2))
    a0 = F.least(F.length(late), room - b0)
    keep_b = F.when(both, b0 + F.least(room - b0 - a0, F.length(short) - b0)).when(short != "", F.greatest(F.lit(0), rest - s)).otherwise(0)
    keep_a = F.when(both, a0).when(late != "", F.greatest(F.lit(0), rest - s)).otherwise(0)
    tail = F.when(keep_b > 0, F.right(short, keep_b.cast("int"))).otherwise("")
    head = F.when(keep_a > 0, F.left(late, keep_a.cast("int"))).otherwise("")
    fitted = F.array_join(F.filter(F.array(tail, body, head), lambda x: x != ""), sep)
    cut = strip_end(F.left(body, budget.cast("int")))
    return F.when(budget.isNull() | (F.length(whole) <= budget), whole).when(F.length(body) >= budget, cut).otherwise(fitted)


def citation_ids(hits: DataFrame, base: str = "base", result_id: str = "id") -> DataFrame:
    """``citation_id``: the base name, with a stable suffix wherever a query has it more than once."""
    many = F.count(F.lit(1)).over(Window.partitionBy("qid", base)) > 1
    return hits.withColumn("citation_id", F.when(many, F.concat(base, F.lit("-"), short_hash(F.col(result_id).cast("string")))).otherwise(F.col(base)))


def location_label(section: Column, sheet: Column | None = None, slide: Column | None = None, page: Column | None = None, rows: Column | None = None, line_start: Column | None = None, line_end: Column | None = None, chunk: Column | None = None) -> Column:
    """Where a snippet lies, in words; a part that the section path already names is left out."""
    none = F.lit(None).cast("string")
    sheet, slide, page, rows, line_start, line_end, chunk = (x if x is not None else none for x in (sheet, slide, page, rows, line_start, line_end, chunk))
    named = F.lower(F.coalesce(section, F.lit("")))

    def part(label: Column) -> Column:
        return F.when(label.isNotNull() & ~F.contains(named, F.lower(label)), label)

    line = F.when(line_end.isNull() | (line_end == line_start), F.concat(F.lit("line "), line_start.cast("string"))).otherwise(F.concat(F.lit("lines "), line_start.cast("string"), F.lit("-"), line_end.cast("string")))
    return F.concat_ws(
        ", ", F.coalesce(F.nullif(section, F.lit("")), F.concat(F.lit("sheet "), sheet)), part(F.concat(F.lit("slide "), slide.cast("string"))), part(F.concat(F.lit("page "), page.cast("string"))),
        part(F.concat(F.lit("rows "), rows)), part(F.when(line_start.isNotNull(), line)), F.concat(F.lit("chunk "), chunk.cast("string")),
    )


def pack_context(hits: DataFrame, max_snippets: int, budget: int | None, chars_per_token: int = 4, space: str = SPACE_CHARS) -> DataFrame:
    """One row a query: snippets within a budget, as an ordered fold.

    ``hits``: qid, rank, dedupe_key, header, text. Snippets are joined by two
    characters, a header and its text by one; a later hit of a known key is dropped;
    the last snippet that fits in part is cut, and white space at its end (the characters
    of ``space``) goes, which may leave room for the next. Returns snippets (array of rank, header, text,
    truncated, char_count, token_estimate), dropped, truncated, char_count, token_estimate.
    """
    snippet = "struct<rank:int,header:string,text:string,truncated:boolean,char_count:int,token_estimate:int,key:string>"
    listed = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "dedupe_key", "header", "text"))).alias("rows"))
    start = F.struct(F.array().cast(f"array<{snippet}>").alias("out"), F.lit(budget if budget is not None else 2**31 - 1).cast("int").alias("left"), F.lit(0).alias("dropped"), F.lit(False).alias("cut"), F.lit(False).alias("stop"))

    def add(acc: Column, r: Column) -> Column:
        n = F.size(acc["out"])
        full = acc["stop"] | (n >= max_snippets) | (acc["left"] <= 0)
        known = ~(acc["stop"] | (n >= max_snippets)) & F.exists(acc["out"], lambda s: s["key"] == r["dedupe_key"])
        sep = F.when(n > 0, 2).otherwise(0)
        room = acc["left"] - sep - F.length(r["header"]) - 1
        stop = ~known & (full | (acc["left"] <= sep) | (room <= 0))
        short = F.length(r["text"]) > room
        text = F.when(short, F.rtrim(F.left(r["text"], room), F.lit(space))).otherwise(r["text"])
        size = F.length(r["header"]) + 1 + F.length(text)
        new = F.struct((n + 1).alias("rank"), r["header"].alias("header"), text.alias("text"), short.alias("truncated"), size.alias("char_count"), F.ceil(size / chars_per_token).cast("int").alias("token_estimate"), r["dedupe_key"].alias("key"))
        skip = known | stop
        return F.struct(
            F.when(skip, acc["out"]).otherwise(F.concat(acc["out"], F.array(new).cast(f"array<{snippet}>"))).alias("out"),
            F.when(skip, acc["left"]).otherwise(acc["left"] - sep - size).cast("int").alias("left"),
            (acc["dropped"] + skip.cast("int")).alias("dropped"),
            (acc["cut"] | stop | F.when(skip, F.lit(False)).otherwise(short)).alias("cut"),
            (acc["stop"] | stop).alias("stop"),
        )

    done = listed.withColumn("_f", F.aggregate("rows", start, add))
    out = F.col("_f.out")
    chars = F.aggregate(out, F.lit(0), lambda a, s: a + s["char_count"]) + 2 * F.greatest(F.size(out) - 1, F.lit(0))
    return done.select(
        "qid", F.transform(out, lambda s: s.dropFields("key")).alias("snippets"), F.col("_f.dropped").alias("dropped"), F.col("_f.cut").alias("truncated"),
        chars.alias("char_count"), F.aggregate(out, F.lit(0), lambda a, s: a + s["token_estimate"]).alias("token_estimate"),
    )


def prompt_place(rank: Column, n: Column, order: str = "rank") -> Column:
    """Place of a snippet in the prompt: by rank, or ``extrema``, the best at both ends."""
    if order == "rank":
        return rank
    if order != "extrema":
        raise ValueError(f"context order {order!r}")
    k = rank - 1
    return F.when(k % 2 == 0, F.floor(k / 2) + 1).otherwise(n - F.floor(k / 2)).cast("int")


def evidence_span(start: Column, end: Column, reliable: Column, artifact: Column) -> Column:
    """Struct of artifact and offsets; null where offsets are missing, inverted or not reliable."""
    return F.when(reliable & start.isNotNull() & end.isNotNull() & (start >= 0) & (end >= start), F.struct(artifact.alias("artifact_id"), start.alias("start_char"), end.alias("end_char")))
