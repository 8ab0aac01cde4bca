"""What is stored of a chunk, what comes back as a hit, and what of a hit is shown, exported or logged.

A payload is a JSON text; reading it back checks types by field, as stores return
whatever was once written. A value of another type counts as missing; a required
one that is missing is an error when the row is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import safe_score

TEXTS = ("source_type", "namespace", "document_id", "collection", "document_key", "content_sha256", "title", "section_id", "section_title", "section_path", "document_path", "embedding_model", "chunker_strategy", "result_type", "figure_id")
NUMBERS = ("chunk_index", "chunk_word_count", "chunk_token_estimate", "start_char", "end_char")
HIDDEN_FROM_PROMPTS = ("id", "document_id", "document_key", "content_sha256", "namespace", "collection")
SENSITIVE = frozenset({"query", "text", "filename", "path", "error", "traceback"})  # fields that logs of events leave out
PRIVATE_CASE_FIELDS = ("query", "expected_context_contains", "forbidden_context_contains", "forbidden_private_identifiers")


def content_type(is_code: Column) -> Column:
    return F.when(F.coalesce(is_code, F.lit(False)), "code").otherwise("document")


def token_estimate_of(token_count: Column, text: Column) -> Column:
    """A chunk's tokens if they were counted, else 1.3 a word, rounded half to even, one at least."""
    words = F.regexp_count(text, F.lit(r"\S+"))
    return F.when(F.coalesce(token_count, F.lit(0)) != 0, token_count.cast("long")).otherwise(F.greatest(F.lit(1), F.bround(words * F.lit(1.3).cast("double")))).cast("long")


def stored_payload(fields: dict[str, Column], metadata: Column | None = None, spans: dict[str, Column] | None = None, section: dict[str, Column] | None = None) -> Column:
    """JSON of a chunk: ``fields``, then metadata that takes no field's name, the chunk's own spans, and a section's locators.

    A section's values win over fields, but not over the chunk's own spans. Nulls are left out.
    """
    own = dict(fields) | {k: v for k, v in (section or {}).items() if k not in (spans or {})}
    for k, v in (spans or {}).items():
        own[k] = F.coalesce(v, section[k]) if section and k in section else v
    body = F.to_json(F.struct(*[v.alias(k) for k, v in own.items()]))
    if metadata is None:
        return body
    free = F.map_filter(metadata, lambda k, v: ~k.isin(*own) & v.isNotNull())
    tail = F.to_json(free)
    return F.when(F.size(free) == 0, body).otherwise(F.concat(F.substr(body, F.lit(1), F.length(body) - 1), F.when(body == "{}", "").otherwise(","), F.substr(tail, F.lit(2))))


def _typed(payload: Column, key: str, kind: str, names: tuple[str, ...]) -> Column:
    value = F.try_variant_get(payload, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(value).isin(*names), F.try_variant_get(payload, f"$.{key}", kind))


def optional_text(payload: Column, key: str) -> Column:
    return _typed(payload, key, "string", ("STRING",))


def optional_number(payload: Column, key: str) -> Column:
    """A whole number; true and false are none."""
    return _typed(payload, key, "long", ("BIGINT",))


def required_text(payload: Column, key: str) -> Column:
    return F.coalesce(optional_text(payload, key), F.raise_error(F.lit(f"a payload has no text {key}")).cast("string"))


def result_rows(points: DataFrame, payload: str = "payload", id_col: str = "id", score: str = "score") -> DataFrame:
    """Rows of (id, payload, score) as hits: checked fields, a finite score, zero if it was not."""
    p = points.select(F.col(id_col).alias("id"), safe_score(F.col(score)).alias("score"), F.parse_json(payload).alias("p"))
    v = F.col("p")
    found = [required_text(v, k).alias(k) for k in ("text", "content_type")] + [optional_text(v, k).alias(k) for k in TEXTS] + [optional_number(v, k).alias(k) for k in NUMBERS]
    return p.select("id", "score", *found, F.coalesce(F.nullif(optional_text(v, "thumbnail_url"), F.lit("")), optional_text(v, "figure_thumbnail_url")).alias("figure_thumbnail_url")).withColumn("source_type", F.coalesce("source_type", F.lit("")))


def _without(m: Column, over: Column) -> Column:
    return F.map_filter(m, lambda k, v: ~F.map_contains_key(over, k))


def layered(*maps: Column) -> Column:
    """Maps laid over one another: of a key the last one's value. Null maps are empty."""
    out = F.coalesce(maps[0], F.create_map().cast("map<string,string>"))
    for m in maps[1:]:
        over = F.coalesce(m, F.create_map().cast("map<string,string>"))
        out = F.map_concat(_without(out, over), over)
    return out


def with_sections(chunks: DataFrame, mappings: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Chunks with the section of a mapping (document_id, chunk_index, section: map) laid over their own; the title is the path's last part if there is none."""
    section = layered(F.col(metadata), F.col("section"))
    path = F.try_element_at("s", F.lit("section_path"))
    title = F.trim(F.element_at(F.split(path, ">"), -1))
    named = F.when(path.isNotNull() & ~F.map_contains_key("s", "section_title") & (title != ""), F.map_concat("s", F.create_map(F.lit("section_title"), title))).otherwise(F.col("s"))
    return chunks.join(mappings, ["document_id", "chunk_index"], "left").withColumn("s", section).withColumn("section", named).drop("s")


def dedupe_key(text_hash: Column) -> Column:
    """Identity of a hit as a source: content and chunk, else document and chunk, section id or section path, else the hit itself."""
    c = F.col
    document = F.when(c("document_id").isNotNull(), F.array(F.lit("document_id"), F.coalesce("namespace", F.lit("")), F.coalesce("collection", F.lit("")), "document_id")).when(c("document_key").isNotNull(), F.array(F.lit("document_key"), F.coalesce("namespace", F.lit("")), F.coalesce("collection", F.lit("")), "document_key"))
    shown = lambda n: F.coalesce(c(n).cast("string"), F.lit("None"))
    content = F.array(F.lit("content_sha256"), F.coalesce("namespace", F.lit("")), F.coalesce("collection", F.lit("")), c("content_sha256"), F.lit("chunk"), c("chunk_index").cast("string"), F.lit("prepared_text"), text_hash, F.lit("span"), shown("start_char"), shown("end_char"), F.lit("section"), F.coalesce(F.nullif("section_id", F.lit("")), "section_path", F.lit("")), F.lit("chunker"), F.coalesce("chunker_strategy", F.lit("")))
    within = lambda kind, v: F.concat(document, F.array(F.lit(kind), v.cast("string")))
    return (
        F.when((F.coalesce("content_sha256", F.lit("")) != "") & c("chunk_index").isNotNull(), content).when(document.isNotNull() & c("chunk_index").isNotNull(), within("chunk", c("chunk_index")))
        .when(document.isNotNull() & (F.coalesce("section_id", F.lit("")) != ""), within("section_id", c("section_id"))).when(document.isNotNull() & (F.coalesce("section_path", F.lit("")) != ""), within("section_path", c("section_path")))
        .otherwise(F.array(F.lit("result_id"), c("id").cast("string")))
    )


LOCATOR = ("chunk_index", "content_sha256", "section_path", "sheet_name", "row_range", "page_number", "slide_number", "line_start", "line_end", "start_char", "end_char", "figure_id")


def locator(unreliable: Column, columns: Sequence[str]) -> Column:
    """Struct of where a hit lies; if its offsets are unreliable only what does not hang on them: chunk, hash, section, sheet and rows."""
    sure = LOCATOR[:5]
    return F.struct(*[(F.col(n) if n in sure else F.when(~F.coalesce(unreliable, F.lit(False)), F.col(n))).alias(n) for n in LOCATOR if n in columns])


def prompt_snippets(snippets: DataFrame, by: str = "qid", rank: str = "rank") -> DataFrame:
    """Snippets as a model may see them: labelled S1, S2, ... by rank, without identifiers, keys and hashes."""
    label = F.concat(F.lit("S"), F.col(rank).cast("string"))
    return snippets.select(by, rank, label.alias("citation_id"), *[c for c in snippets.columns if c not in (by, rank, "citation_id", *HIDDEN_FROM_PROMPTS)])


def rerank_metadata(payload: Column) -> Column:
    """Struct of a hit's rerank record, each field of its type or null: texts that are not blank, finite numbers, whole ranks."""
    text = lambda k: F.when(F.trim(optional_text(payload, k)) != "", optional_text(payload, k))
    number = lambda k: _typed(payload, k, "double", ("BIGINT", "DOUBLE", "DECIMAL(2,1)", *[f"DECIMAL({p},{s})" for p in range(1, 19) for s in range(p + 1)]))
    return F.struct(*[text(k).alias(k) for k in ("provider", "model")], *[number(k).alias(k) for k in ("provider_score", "search_score")], *[optional_number(payload, k).alias(k) for k in ("original_rank", "rerank_rank", "rank_delta")])


EXPORT = {"id": "id", "content": "text", "score": "score", "document_id": "document_id", "document_key": "document_key", "collection": "collection", "namespace": "namespace", "title": "title", "chunk_index": "chunk_index", "section_path": "section_path"}


def exported_hits(hits: DataFrame, by: str = "qid") -> DataFrame:
    """Hits as JSON texts for tracing tools; what a hit lacks is left out."""
    return hits.select(by, "rank", F.to_json(F.struct(*[F.col(v).alias(k) for k, v in EXPORT.items() if v in hits.columns])).alias("hit"))


def event_json(events: DataFrame, sensitive: frozenset[str] = SENSITIVE) -> DataFrame:
    """Events as JSON lines without the fields that may hold what users wrote; zero timestamps are left out."""
    shown = [F.when(F.col(c) != 0, F.col(c)).alias(c) if c in ("emitted_at_ns", "wall_clock_ns") else F.col(c) for c in events.columns if c not in sensitive]
    return events.select(F.to_json(F.struct(*shown)).alias("value"))


def redacted_cases(cases: DataFrame, private: Sequence[str] = PRIVATE_CASE_FIELDS) -> DataFrame:
    """A report's cases without what was asked and what was looked for."""
    return cases.drop(*[c for c in private if c in cases.columns])


def matches_scope(query: DataFrame, hits: DataFrame, by: str = "qid") -> DataFrame:
    """Hits of a second source that lie in their query's scope: namespace, and collections and content types where they are given (an empty list lets nothing through)."""
    def within(given: str, value: str) -> Column:
        return F.col(f"q.{given}").isNull() | F.coalesce(F.array_contains(f"q.{given}", F.col(f"h.{value}")), F.lit(False))

    on = (F.col(f"h.{by}") == F.col(f"q.{by}")) & (F.col("h.namespace") == F.col("q.namespace")) & within("collections", "collection") & within("content_types", "content_type")
    return hits.alias("h").join(query.alias("q"), on, "left_semi")


def contextualized(chunks: DataFrame, contexts: DataFrame, cap: int | None = None) -> DataFrame:
    """Chunks with ``embedding_text``: a context (document_id, chunk_index, context) and an empty line before the text of the first ``cap`` chunks of a document."""
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index"))
    placed = chunks.withColumn("_place", place) if cap is not None else chunks.withColumn("_place", F.lit(0))
    given = F.col("_place") <= (cap if cap is not None else 0)
    text = F.when(given & (F.coalesce("context", F.lit("")) != ""), F.concat_ws("\n\n", "context", "text")).otherwise(F.col("text"))
    return placed.join(contexts, ["document_id", "chunk_index"], "left").withColumn("embedding_text", text).drop("_place", "context")


def hypothetical(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """Queries with the text to embed densely: a passage (qid, passage) that might answer, or the query if none came; sparse search keeps the query."""
    passage = F.nullif(F.trim("passage"), F.lit(""))
    return queries.join(passages, "qid", "left").select("qid", F.coalesce(passage, F.col("query")).alias("dense_query_text"), F.col("query").alias("sparse_query_text"), passage.isNull().alias("fell_back"))


def expected_by_alias(cases: DataFrame, aliases: DataFrame) -> DataFrame:
    """Cases (case_id, expected_ids) whose ids are document keys where an alias (alias, document_key) is known; order is kept."""
    each = cases.select("case_id", F.posexplode("expected_ids").alias("n", "alias"))
    named = each.join(aliases, "alias", "left").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("n", F.coalesce("document_key", "alias").alias("v")))).alias("e"))
    return named.select("case_id", F.transform("e", lambda x: x["v"]).alias("expected_ids"))
