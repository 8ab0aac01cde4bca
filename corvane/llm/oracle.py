"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

SP = r"[\x20\x09-\x0D]+"

QUALITY = rf"""
WITH src AS (
  SELECT doc_id, text, row_number() OVER () AS k FROM documents
), base AS (
  SELECT k, doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '{SP}'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM src
), w AS (
  SELECT k, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM base
), tri AS (
  SELECT k, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p AS t FROM w WINDOW p AS (PARTITION BY k ORDER BY i)
), dup AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, t) AS n FROM tri WHERE t IS NOT NULL) WHERE n > 1
), cov AS (
  SELECT k, count(DISTINCT i + d) AS n FROM dup, (VALUES (0), (1), (2)) AS o(d) GROUP BY k
), m AS (
  SELECT b.doc_id, len(b.ws)::BIGINT AS n_words, length(regexp_replace(coalesce(b.text, ''), '{SP}', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(coalesce(b.text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(b.ls) - len(list_distinct(b.ls)))::BIGINT AS n_dup_lines, len(b.ls) AS n_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(coalesce(b.text, ''), '[^\p{{Lu}}]+', '', 'g')) AS n_upper
  FROM base b LEFT JOIN cov c USING (k)
), f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 2 * n_upper > word_chars OR 10 * n_dup_lines > 4 * n_lines
            OR word_chars > 15 * n_words OR word_chars < 2 * n_words) AS kept
FROM f
"""

DECONTAMINATION = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS t
  FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM item WHERE len(ws) > 0)
), doc AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), dw AS (
  SELECT k, n, i, array_to_string(ws[i:i + n - 1], ' ') AS t
  FROM (SELECT k, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)
), hit AS (
  SELECT k, i, dw.n, item_id FROM dw JOIN win ON dw.n = win.n AND dw.t = win.t
), cov AS (
  SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM hit) GROUP BY k
), its AS (
  SELECT k, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT k, item_id::VARCHAR AS x FROM hit) GROUP BY k
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM doc LEFT JOIN cov USING (k) LEFT JOIN its USING (k)
"""

ORACLES = {"op8_decontamination": DECONTAMINATION, "op9_quality_rules": QUALITY}
