"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from barlake.plans.oracle import unescape_sql

_OP2 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages),
r AS (
  SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS payload_digest,
         CASE WHEN strlen(payload) >= 1000 THEN max(page_id) OVER (PARTITION BY payload) END AS top
  FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN top IS NOT NULL AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top IS NOT NULL AND top <> page_id THEN top END AS refers_to
FROM r
"""

_OP4 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 5) r(k) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, text, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(ls) AS n_lines,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS n_stutter
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
g AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         n_symbols * 100 > n_words * 10 OR n_dup_lines * 100 > n_lines * 50 OR n_stutter * 100 > n_words * 30
         OR (length(text) - length(replace(text, '!!', '!'))) * 100 > n_words * 10
         OR length(regexp_replace(text, '\P{Lu}+', '', 'g')) * 2 > length(regexp_replace(text, '\P{L}+', '', 'g'))
         OR length(regexp_replace(text, '[^\p{L}\p{M}]+', '', 'g')) * 2 < word_chars AS junk
  FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT junk AS kept
FROM g
"""

# the pages mark their article, and hold no boilerplate inside it
_OP9 = f"""
WITH a AS (
  SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?b>', '', 'g') AS body
  FROM pages),
b AS (
  SELECT page_id, url, list_filter(list_transform(string_split_regex(body, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(
    {unescape_sql("regexp_replace(x, '<[^>]+>', ' ', 'g')")}, '\\s+', ' ', 'g'))), lambda x: x <> '') AS blocks
  FROM a)
SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, CAST(length(array_to_string(blocks, chr(10))) AS BIGINT) AS n_chars
FROM b
"""

ORACLES: dict[str, str] = {
    "op2_warc_round_trip": _OP2,
    "op4_quality_rules": _OP4,
    "op9_html_main_text": _OP9,
}
