"""Registered queries of payloads, projections and indexing over the driver's tables, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.catalog import SQL_CANON, dense_hits, documents, register, sql_dense
from corvane.functions import text, urls
from corvane.operators import assemble, indexing, payloads, retrieve
from corvane.plans import filters
from corvane.sources.readers import table


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as chunks of documents."""
    return table(spark, d, "conversations").select(F.lit("acme").alias("namespace"), F.col("role").alias("collection"), F.col("conv_id").cast("string").alias("document_id"), F.col("turn").alias("chunk_index"), F.coalesce("text", F.lit("")).alias("text"))


SQL_TURNS = "t AS (SELECT 'acme' AS namespace, role AS collection, conv_id::VARCHAR AS document_id, turn AS chunk_index, coalesce(text, '') AS text FROM conversations)"


# --- payloads ----------------------------------------------------------------------------------------------------------


@register("SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR source = 'code' THEN 'code' ELSE 'document' END AS content_type FROM documents")
def prj03_content_types(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", payloads.content_type((F.col("doc_id") % 3 == 0) | (F.col("source") == "code")).alias("content_type"))


SQL_PAYLOAD = """SELECT document_id, chunk_index, json_object('namespace', namespace, 'collection', collection, 'document_id', document_id, 'chunk_index', chunk_index, 'text', text, 'content_type', 'document', 'title', 'turn',
 'chunk_token_estimate', CASE WHEN chunk_index % 2 = 0 THEN 7 ELSE greatest(1, round_even(len(regexp_extract_all(text, '\\S+')) * 1.3::DOUBLE, 0)::BIGINT) END, 'section_path', 'a > b', 'start_char', chunk_index, 'end_char', 9, 'lang', 'xx') AS payload FROM t"""


def turn_payloads(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    fields = {c: F.col(c) for c in ("namespace", "collection", "document_id", "chunk_index", "text")} | {"content_type": F.lit("document"), "title": F.lit("turn"), "chunk_token_estimate": payloads.token_estimate_of(F.when(F.col("chunk_index") % 2 == 0, 7), F.col("text"))}
    meta = F.create_map(F.lit("lang"), F.lit("xx"), F.lit("title"), F.lit("not this"), F.lit("none"), F.lit(None).cast("string"))
    payload = payloads.stored_payload(fields, meta, {"start_char": F.col("chunk_index"), "end_char": F.lit(None).cast("long")}, {"section_path": F.lit("a > b"), "start_char": F.lit(-1).cast("long"), "end_char": F.lit(9).cast("long")})
    return t.select("document_id", "chunk_index", payload.alias("payload"))


@register(f"WITH {SQL_TURNS}, p AS ({SQL_PAYLOAD}) SELECT document_id, chunk_index, payload->>'title' AS title, payload->>'lang' AS lang, (payload->>'chunk_token_estimate')::BIGINT AS tokens, (payload->>'start_char')::BIGINT AS start_char, (payload->>'end_char')::BIGINT AS end_char, length(payload->>'text') AS chars FROM p")
def prj04_stored_payloads(spark: SparkSession, d: str) -> DataFrame:
    get = lambda k: F.get_json_object("payload", f"$.{k}")
    return turn_payloads(spark, d).select("document_id", "chunk_index", get("title").alias("title"), get("lang").alias("lang"), get("chunk_token_estimate").cast("long").alias("tokens"), get("start_char").cast("long").alias("start_char"), get("end_char").cast("long").alias("end_char"), F.length(get("text")).alias("chars"))


@register(f"""WITH {SQL_TURNS} SELECT document_id || '#' || chunk_index AS id, CASE WHEN chunk_index % 3 = 0 THEN 0.0::DOUBLE ELSE chunk_index::DOUBLE END AS score, text, 'document' AS content_type, '' AS source_type, collection, 'turn' AS title, chunk_index, 9 AS end_char, NULL::VARCHAR AS section_id FROM t""")
def prj05_result_rows(spark: SparkSession, d: str) -> DataFrame:
    points = turn_payloads(spark, d).select(F.concat_ws("#", "document_id", "chunk_index").alias("id"), F.when(F.col("chunk_index") % 3 == 0, float("nan")).otherwise(F.col("chunk_index").cast("double")).alias("score"), F.regexp_replace("payload", '"lang":"xx"', '"section_id":5').alias("payload"))
    return payloads.result_rows(points).select("id", "score", "text", "content_type", "source_type", "collection", "title", "chunk_index", "end_char", "section_id")


@register("SELECT conv_id::VARCHAR AS document_id, turn AS chunk_index, CASE WHEN turn % 2 = 0 THEN 'new > ' || role ELSE 'old' END AS section_path, CASE WHEN turn % 2 = 0 THEN role ELSE 'old' END AS section_title, 'k' AS kept FROM conversations")
def prj08_sections(spark: SparkSession, d: str) -> DataFrame:
    chunks = turns(spark, d).withColumn("metadata", F.create_map(F.lit("section_path"), F.lit("old"), F.lit("kept"), F.lit("k")))
    mappings = chunks.filter("chunk_index % 2 = 0").select("document_id", "chunk_index", F.create_map(F.lit("section_path"), F.concat(F.lit("new > "), "collection")).alias("section"))
    out = payloads.with_sections(chunks.drop("section"), mappings)
    return out.select("document_id", "chunk_index", *[F.try_element_at("section", F.lit(k)).alias(k) for k in ("section_path", "section_title", "kept")])


@register("SELECT doc_id, 'document' AS a, coalesce(source, '-') AS b, CASE WHEN doc_id % 2 = 0 THEN 'chunk' ELSE 'extra' END AS c FROM documents")
def prj12_metadata_layers(spark: SparkSession, d: str) -> DataFrame:
    m = lambda *kv: F.create_map(*[x if not isinstance(x, str) else F.lit(x) for x in kv])
    laid = payloads.layered(m("a", "document", "b", "x", "c", "y"), m("b", F.coalesce("source", F.lit("-")), "c", "extra"), F.when(F.col("doc_id") % 2 == 0, m("c", "chunk")))
    return documents(spark, d).select("doc_id", laid.alias("m")).select("doc_id", *[F.element_at("m", k).alias(k) for k in "abc"])


# --- context -----------------------------------------------------------------------------------------------------------


@register("""SELECT doc_id, CASE WHEN doc_id % 5 < 2 AND source IS NOT NULL THEN 'content_sha256|acme||' || sha256(source) || '|chunk|' || doc_id % 7 || '|prepared_text|' || left(sha256(coalesce(text, '')), 12) || '|span|None|' || n_chars || '|section|s|chunker|'
 WHEN doc_id % 5 = 2 THEN 'document_id|acme||d' || doc_id // 10 || '|chunk|' || doc_id % 7 WHEN doc_id % 5 = 3 THEN 'document_id|acme||d' || doc_id // 10 || '|section_path|s' ELSE 'result_id|' || doc_id END AS dedupe_key FROM documents""")
def ctx02_dedupe_keys(spark: SparkSession, d: str) -> DataFrame:
    k, none = F.col("doc_id") % 5, F.lit(None).cast("string")
    hits = documents(spark, d).select(
        "doc_id", F.col("doc_id").alias("id"), F.lit("acme").alias("namespace"), none.alias("collection"), F.when(k.isin(2, 3), F.concat(F.lit("d"), F.floor(F.col("doc_id") / 10).cast("string"))).alias("document_id"), none.alias("document_key"),
        F.when(k < 2, F.sha2(F.col("source").cast("binary"), 256)).alias("content_sha256"), F.when(k < 3, F.col("doc_id") % 7).alias("chunk_index"), none.alias("start_char"), F.col("n_chars").alias("end_char"), none.alias("section_id"), F.lit("s").alias("section_path"), none.alias("chunker_strategy"), "text",
    )
    key = payloads.dedupe_key(F.left(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), F.lit(12)))
    return hits.select("doc_id", F.array_join(key, "|").alias("dedupe_key"))


@register(f"WITH {sql_dense(5)} SELECT qid, rank, 'S' || rank AS citation_id, score FROM dense")
def ctx08_prompt_snippets(spark: SparkSession, d: str) -> DataFrame:
    return payloads.prompt_snippets(dense_hits(spark, d, 5).withColumn("document_key", F.col("id")))


@register("SELECT conv_id, turn, turn AS chunk_index, role AS section_path, CASE WHEN turn % 3 <> 0 THEN conv_id END AS page_number, CASE WHEN turn % 3 <> 0 THEN length(text) END AS end_char FROM conversations")
def ctx10_locators(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "conversations").select("conv_id", "turn", F.col("turn").alias("chunk_index"), F.col("role").alias("section_path"), F.col("conv_id").alias("page_number"), F.length("text").alias("end_char"))
    where = payloads.locator(F.col("turn") % 3 == 0, hits.columns)
    return hits.select("conv_id", "turn", where.alias("w")).select("conv_id", "turn", "w.chunk_index", "w.section_path", "w.page_number", "w.end_char")


@register("SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_type END AS provider, value AS provider_score, CASE WHEN event_id % 2 = 0 THEN event_id END AS original_rank FROM events")
def ctx12_rerank_metadata(spark: SparkSession, d: str) -> DataFrame:
    record = F.concat(F.lit('{"provider":"'), F.when(F.col("event_id") % 4 == 0, " ").otherwise(F.col("event_type")), F.lit('","original_rank":'), F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise("true"), F.coalesce(F.concat(F.lit(',"provider_score":'), F.col("value").cast("string")), F.lit("")), F.lit("}"))
    return table(spark, d, "events").select("event_id", payloads.rerank_metadata(F.parse_json(record)).alias("r")).select("event_id", "r.provider", "r.provider_score", "r.original_rank")


@register(f"WITH {sql_dense(5)} SELECT qid, rank, id, score FROM dense")
def snk02_exported_hits(spark: SparkSession, d: str) -> DataFrame:
    out = payloads.exported_hits(dense_hits(spark, d, 5))
    return out.select("qid", "rank", F.get_json_object("hit", "$.id").cast("long").alias("id"), F.get_json_object("hit", "$.score").cast("double").alias("score"))


@register("SELECT event_id, event_type, value, false AS leaks FROM events")
def agg19_event_payloads(spark: SparkSession, d: str) -> DataFrame:
    lines = payloads.event_json(table(spark, d, "events").select("event_id", "event_type", "value", F.col("props").alias("query"), F.lit(0).alias("wall_clock_ns")))
    get = lambda k: F.get_json_object("value", f"$.{k}")
    return lines.select(get("event_id").cast("long").alias("event_id"), get("event_type").alias("event_type"), get("value").cast("double").alias("value"), (get("query").isNotNull() | get("wall_clock_ns").isNotNull()).alias("leaks"))


@register("SELECT item_id AS case_id, length(text) AS n FROM benchmark")
def agg09_redacted_cases(spark: SparkSession, d: str) -> DataFrame:
    return payloads.redacted_cases(table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("query"), F.array("text").alias("expected_context_contains"), F.length("text").alias("n")))


@register("SELECT c_custkey AS case_id, ['k' || c_nationkey, CASE WHEN c_custkey % 25 < 20 THEN 'k' || (c_custkey % 25) ELSE 'n' || (c_custkey % 25) END] AS expected_ids FROM customer")
def agg18_expected_by_alias(spark: SparkSession, d: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c) if isinstance(c, str) else c)
    cases = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.array(name("k", "c_nationkey"), name("n", F.col("c_custkey") % 25)).alias("expected_ids"))
    aliases = table(spark, d, "nation").filter("n_nationkey < 20").select(name("n", "n_nationkey").alias("alias"), name("k", "n_nationkey").alias("document_key"))
    return payloads.expected_by_alias(cases, aliases)


@register("SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders WHERE o_orderdate::DATE::VARCHAR >= '1995-03' AND o_orderdate::DATE::VARCHAR < '1996-11-15'")
def flt04_text_ranges(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return filters.apply(orders, node=filters.Range("day", gte="1995-03", lt="1996-11-15"))


@register(f"WITH {sql_dense(20)} SELECT d.qid, d.id, d.rank FROM dense d JOIN embeddings e ON d.id = e.vec_id WHERE CASE WHEN d.qid % 2 = 0 THEN e.label IN (1, 3, 5, 7) ELSE true END AND d.id % 7 <> 0 AND d.qid % 100 <> 50")
def flt10_sidecar_refilter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("collection"), F.when(F.col("vec_id") % 7 == 0, "other").otherwise("acme").alias("namespace"), F.lit("document").alias("content_type"))
    hits = dense_hits(spark, d, 20).join(e, "id")
    q = hits.select("qid").distinct().select("qid", F.lit("acme").alias("namespace"), F.when(F.col("qid") % 2 == 0, F.array(*[F.lit(x) for x in (1, 3, 5, 7)])).alias("collections"), F.when(F.col("qid") % 100 == 50, F.array().cast("array<string>")).alias("content_types"))
    return payloads.matches_scope(q, hits).select("qid", "id", "rank")


@register("""SELECT conv_id::VARCHAR AS document_id, turn AS chunk_index, CASE WHEN turn % 2 = 0 AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3 THEN 'about ' || role || chr(10) || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END AS embedding_text FROM conversations""")
def chk13_contextualized(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    contexts = t.select("document_id", "chunk_index", F.when(F.col("chunk_index") % 2 == 0, F.concat(F.lit("about "), "collection")).otherwise("").alias("context"))
    return payloads.contextualized(t, contexts, cap=3).select("document_id", "chunk_index", "embedding_text")


@register("SELECT item_id AS qid, CASE WHEN item_id % 3 = 0 THEN text ELSE 'passage ' || item_id END AS dense_query_text, text AS sparse_query_text, item_id % 3 = 0 AS fell_back FROM benchmark WHERE text IS NOT NULL")
def ret28_hypothetical(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "benchmark").filter("text is not null").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    passages = q.filter("qid % 3 <> 2").select("qid", F.when(F.col("qid") % 3 == 0, "  ").otherwise(F.concat(F.lit("passage "), "qid")).alias("passage"))
    more = q.filter("qid % 3 = 2").select("qid", F.concat(F.lit(" passage "), F.col("qid").cast("string"), F.lit(" ")).alias("passage"))
    return payloads.hypothetical(q, passages.unionByName(more))


@register(f"""WITH {sql_dense(40)}, h AS (SELECT d.*, 'l' || e.label || '-' || d.id % 3 AS text FROM dense d JOIN embeddings e ON d.id = e.vec_id),
g AS (SELECT qid, text, min(struct_pack(s := -score, i := id)) AS b, min(rank) AS r FROM h GROUP BY ALL)
SELECT qid, b.i AS id, row_number() OVER (PARTITION BY qid ORDER BY r, b.i) AS rank FROM g QUALIFY rank <= 10""")
def ret40_overfetched(spark: SparkSession, d: str) -> DataFrame:
    """Ten hits after equal ones were collapsed: the prefetch limit of ten is asked for first."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("l"), "label").alias("l"))
    hits = dense_hits(spark, d, 40).join(e, "id").select("qid", "id", "score", "rank", F.lit("text").alias("kind"), F.concat("l", F.lit("-"), F.col("id") % 3).alias("text"))
    return assemble.collapse_equal(hits, 10).select("qid", "id", "rank")


# --- indexing ----------------------------------------------------------------------------------------------------------


@register(f"""WITH {SQL_TURNS} SELECT document_id, chunk_index, CASE WHEN document_id::BIGINT % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM t WHERE document_id::BIGINT % 6 <> 3 AND (document_id::BIGINT % 3 <> 0 OR chunk_index < 2)""")
def idx02_index_documents(spark: SparkSession, d: str) -> DataFrame:
    points = turns(spark, d).withColumns({"version": F.lit("old"), "collection": F.lit("c")})
    n = F.col("document_id").cast("long")
    new = points.filter((n % 3 == 0) & ((F.col("chunk_index") < 2) | (n % 6 == 3))).withColumn("version", F.lit("new")).withColumn("chunk_index", F.when(n % 6 != 3, F.col("chunk_index")))
    return indexing.index_document(points, new).select("document_id", "chunk_index", "version")


@register("SELECT user_id AS key, user_id % 3 <> 0 AS cached, 2::BIGINT AS n FROM events WHERE user_id IS NOT NULL GROUP BY ALL")
def idx04_embedded_texts(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "events").filter("user_id is not null").select(F.col("user_id").alias("key"), F.col("user_id").cast("string").alias("text")).distinct()
    cache = texts.filter("key % 3 <> 1 or key % 2 = 0").select("key", F.when(F.col("key") % 3 != 0, F.array(F.lit(1.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0))).alias("vec"))
    cache = cache.unionByName(texts.filter("key % 3 = 1 and key % 2 <> 0").select("key", F.array(F.lit(1.0), F.lit(1.0)).alias("vec")))
    out = indexing.cached_vectors(texts, cache, lambda rest: rest.select("key", F.array(F.length("text").cast("double"), F.lit(0.0)).alias("vec")), 2)
    return out.select("key", (F.get("vec", F.lit(1)) == 1.0).alias("cached"), F.size("vec").cast("long").alias("n"))


@register("SELECT item_id AS key, c AS channel, CASE c WHEN 'splade' THEN length(text) ELSE 1 END::DOUBLE AS val FROM benchmark, (VALUES ('bm25'), ('splade'), ('other')) AS v(c) WHERE text IS NOT NULL")
def idx05_sparse_channels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").filter("text is not null").select(F.col("item_id").alias("key"), "text")
    embed = {"bm25": lambda r: r.select("key", F.lit(0).alias("idx"), F.lit(1.0).alias("val")), "splade": lambda r: r.select("key", F.lit(0).alias("idx"), F.length("text").cast("double").alias("val"))}
    return indexing.sparse_channels(rows, ("bm25", "splade", "other"), embed).select("key", "channel", "val")


@register(f"WITH {SQL_TURNS} SELECT collection, document_id, stage, count(*) AS n FROM t, (VALUES ('store'), ('sidecar'), ('manifest')) AS v(stage) WHERE document_id::BIGINT % 4 <> 0 AND document_id::BIGINT % 5 <> 0 GROUP BY ALL")
def idx08_forgotten(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    n = F.col("document_id").cast("long")
    left = indexing.forget({s: t for s in ("store", "sidecar", "manifest")}, t.filter(n % 4 == 0), t.filter(n % 5 == 0).withColumn("stage", F.lit("manifest")))
    counted = [f.groupBy("collection", "document_id").agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit(s)) for s, f in left.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@register("""WITH l AS (SELECT user_id::VARCHAR AS document_id, ['store', 'sidecar', 'embedding_cache', 'context_cache', 'manifest'][event_id % 5 + 1] AS stage, arg_max(CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'done' END, event_id) AS status FROM events WHERE user_id IS NOT NULL GROUP BY ALL),
g AS (SELECT document_id, list_filter(['store', 'sidecar', 'embedding_cache', 'context_cache', 'manifest'], lambda s: NOT list_contains(coalesce(list(stage) FILTER (status = 'done'), []), s)) AS stages FROM l GROUP BY document_id)
SELECT document_id, stages FROM g WHERE len(stages) > 0""")
def idx08_left_to_forget(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("user_id is not null")
    stage = F.element_at(F.array(*map(F.lit, indexing.FORGET_STAGES)), (F.col("event_id") % 5 + 1).cast("int"))
    log = e.select(F.col("event_id").alias("line_no"), F.lit("acme").alias("namespace"), F.lit("c").alias("collection"), F.col("user_id").cast("string").alias("document_id"), stage.alias("stage"), F.when(F.col("event_id") % 3 == 0, "failed").otherwise("done").alias("status"))
    return indexing.left_to_forget(log).select("document_id", "stages")


@register("SELECT user_id::VARCHAR AS document_id, max(event_id) AS line_no FROM events WHERE user_id IS NOT NULL GROUP BY user_id HAVING max(event_id) % 2 = 0")
def idx09_torn_writes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("user_id is not null")
    log = e.select(F.col("event_id").alias("line_no"), F.lit("acme").alias("namespace"), F.lit("c").alias("collection"), F.col("user_id").cast("string").alias("document_id"), F.when(F.col("event_id") % 2 == 0, "begun").otherwise("committed").alias("status"))
    return indexing.torn_writes(log).select("document_id", "line_no")


@register("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'key' || doc_id WHEN doc_id % 3 = 1 THEN '/' || coalesce(source, '') ELSE doc_id || '.md' END AS document_key, CASE WHEN doc_id % 4 = 0 THEN 'given' END AS given FROM documents")
def idx12_document_keys(spark: SparkSession, d: str) -> DataFrame:
    k, i = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    key = indexing.document_key_of(F.when(k == 0, F.concat(F.lit(" key"), i)).otherwise("  "), F.when(k == 1, F.concat(F.lit("/"), F.coalesce("source", F.lit("")))), F.concat(i, F.lit(".md ")))
    made = indexing.document_id_of(F.when(F.col("doc_id") % 4 == 0, " given "), F.lit("acme"), F.lit("c"), key)
    return documents(spark, d).select("doc_id", key.alias("document_key"), F.when(made == "given", made).alias("given"))


@register("SELECT DISTINCT user_id::VARCHAR AS document_sha256, event_type AS chunk_sha256, 'm' AS contextualizer, CASE WHEN user_id % 2 = 0 THEN 'c' || user_id END AS context, user_id % 2 = 0 AS hit FROM events WHERE user_id IS NOT NULL")
def idx15_context_cache(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "events").filter("user_id is not null").select(F.col("user_id").cast("string").alias("document_sha256"), F.col("event_type").alias("chunk_sha256"), F.lit("m").alias("contextualizer"))
    cache = asked.distinct().filter("document_sha256 % 2 = 0").withColumn("context", F.concat(F.lit("c"), "document_sha256"))
    return indexing.context_cache(asked, cache)


@register("SELECT doc_id::VARCHAR AS document_id FROM documents WHERE doc_id % 4 <> 1")
def idx16_append_if_stale(spark: SparkSession, d: str) -> DataFrame:
    e = documents(spark, d).select(F.lit("acme").alias("namespace"), F.lit("c").alias("collection"), F.col("doc_id").cast("string").alias("document_id"), F.lit("h2").alias("content_sha256"))
    n = F.col("document_id").cast("long")
    lines = e.filter(n % 4 != 0).withColumn("content_sha256", F.when(n % 4 == 1, "h2").otherwise("h1")).withColumn("line_no", F.lit(2)).unionByName(e.withColumn("line_no", F.lit(1)).filter(n % 4 != 0))
    return indexing.append_if_stale(lines, e).select("document_id")


@register("SELECT p_partkey, 'chunks__' || CASE WHEN p_partkey % 2 = 0 THEN 't' || p_size || '__' ELSE '' END || trim(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '_') || '_' || p_size || 'd' AS name FROM part")
def idx20_collection_names(spark: SparkSession, d: str) -> DataFrame:
    slug = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("t"), "p_size")).otherwise("")
    return table(spark, d, "part").select("p_partkey", indexing.collection_name("chunks", F.col("p_type"), F.col("p_size"), slug).alias("name"))


@register("SELECT doc_id::VARCHAR AS document_id, CASE WHEN doc_id % 3 = 0 THEN 5 ELSE 4 END::BIGINT AS chunk_count, doc_id % 3 = 0 OR doc_id % 5 = 0 AS repaired FROM documents")
def idx21_repaired_manifest(spark: SparkSession, d: str) -> DataFrame:
    base = documents(spark, d).select(F.lit("acme").alias("namespace"), F.lit("c").alias("collection"), F.col("doc_id").cast("string").alias("document_id"), F.lit(4).cast("long").alias("chunk_count"), F.lit("h").alias("content_sha256"))
    n = F.col("document_id").cast("long")
    records = base.withColumn("chunk_count", F.when(n % 3 == 0, 5).otherwise(4).cast("long"))
    return indexing.repaired_manifest(base.filter(n % 5 != 0), records).select("document_id", "chunk_count", "repaired")


@register(f"WITH {SQL_TURNS} SELECT document_id, chunk_index, 0.0::DOUBLE AS score FROM t WHERE trim(text) <> ''")
def idx23_sidecar_records(spark: SparkSession, d: str) -> DataFrame:
    return indexing.sidecar_records(turns(spark, d)).select("document_id", "chunk_index", "score")


@register("SELECT p_partkey, lower(p_brand) = p_brand AND NOT contains(p_brand, '/') AS brand, p_partkey % 4 >= 2 AS made FROM part")
def idx25_path_segments(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    return table(spark, d, "part").select("p_partkey", indexing.path_segment(F.col("p_brand")).alias("brand"), indexing.path_segment(F.when(k == 0, "a/b").when(k == 1, "..").when(k == 2, "ok").otherwise("a-b_c")).alias("made"))


@register(f"SELECT {SQL_CANON} AS document_key, CASE WHEN bool_or(page_id % 4 = 0) AND bool_and(page_id % 4 = 0) THEN 'remove' WHEN bool_and(page_id % 4 IN (0, 1)) AND bool_or(page_id % 4 = 0) = false THEN 'create' ELSE 'other' END AS action FROM pages GROUP BY 1 HAVING count(*) = 1 AND (max(page_id) % 4 < 2) UNION ALL SELECT {SQL_CANON}, CASE WHEN max(page_id) % 4 = 2 THEN 'skip' ELSE 'replace' END FROM pages GROUP BY 1 HAVING count(*) = 1 AND (max(page_id) % 4 >= 2)")
def src18_ingest_plan(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "pages").select(urls.canonical(F.col("url")).alias("document_key"), "page_id").groupBy("document_key").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("page_id")).filter("n = 1")
    k = F.col("page_id") % 4
    items = once.filter(k != 0).select("document_key", F.lit("h").alias("content_sha256"))
    known = once.filter(k != 1).select("document_key", F.when(k == 2, "h").otherwise("old").alias("content_sha256"))
    return indexing.ingest_plan(items, known)


@register(f"WITH {SQL_TURNS} SELECT collection, document_id, count(*) AS chunk_count, sum(length(text))::BIGINT AS chars, 'preview' AS state FROM t GROUP BY ALL")
def src20_manifest_preview(spark: SparkSession, d: str) -> DataFrame:
    return indexing.manifest_preview(turns(spark, d)).drop("namespace")


@register("""WITH j AS (SELECT event_id AS job_id, user_id AS owner, CASE event_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'succeeded' ELSE 'failed' END AS status, ts FROM events WHERE user_id IS NOT NULL)
SELECT job_id FROM (SELECT *, row_number() OVER (PARTITION BY owner, status <> 'running' ORDER BY ts DESC, job_id) AS n FROM j) WHERE status = 'running' OR (n <= 3 AND ts >= (SELECT max(ts) FROM events) - INTERVAL '5 days')""")
def snk03_kept_jobs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    now = e.agg(F.max("ts")).first()[0]
    jobs = e.filter("user_id is not null").select(F.col("event_id").alias("job_id"), F.col("user_id").alias("owner"), F.when(F.col("event_id") % 3 == 0, "running").when(F.col("event_id") % 3 == 1, "succeeded").otherwise("failed").alias("status"), F.col("ts").alias("updated_at"))
    return indexing.kept_jobs(jobs, F.lit(now), 5 * 86_400, 3).select("job_id")
