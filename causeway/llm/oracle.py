"""DuckDB SQL of the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

OP4 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, source, t,
         list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)),
                     lambda x: length(regexp_replace(x, '[ \t\n\x0B\f\r]+', '', 'g')) > 0) AS ls
  FROM d),
g AS (
  SELECT doc_id, i, row_number() OVER () AS rn, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
again AS (
  SELECT g.doc_id, unnest([i, i + 1, i + 2]) AS pos
  FROM g JOIN (SELECT doc_id, tri FROM g GROUP BY ALL HAVING count(*) > 1) r USING (doc_id, tri)),
rep AS (SELECT doc_id, count(DISTINCT pos) AS n FROM again GROUP BY doc_id),
m AS (
  SELECT w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[ \t\n\x0B\f\r]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)),
b AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
         (100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines) AS strict,
         (100 * n_symbols > 100 * n_words OR 100 * n_dup_lines > 60 * n_lines) AS clear FROM m),
h AS (
  SELECT source, kind, count(*) AS n, sum(f) AS f, sum(f) / count(*) AS rate
  FROM (SELECT source, 'base' AS kind, CAST(base_failed AS INT) AS f FROM b
        UNION ALL SELECT source, 'strict', CAST(strict AS INT) FROM b)
  GROUP BY source, kind),
p AS (
  SELECT kind, sum(f) / sum(n) AS mean, var_pop(rate) AS var FROM h GROUP BY kind),
s AS (
  SELECT kind, mean, CASE WHEN var > 0 AND mean BETWEEN 1e-12 AND 1 - 1e-12
                          THEN least(1e6, greatest(1.0, mean * (1 - mean) / var - 1)) ELSE 1.0 END AS strength FROM p),
v AS (
  SELECT source, bool_or((f + mean * strength) / (n + strength) > mean + sqrt(mean * (1 - mean) / (strength + 1)) + 1e-9)
         AS host_failed
  FROM h JOIN s USING (kind) GROUP BY source)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT clear AND NOT (coalesce(host_failed, false) AND strict)) AS kept
FROM b LEFT JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""

OP5 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages),
f AS (SELECT body, min(page_id) AS first_id FROM p GROUP BY body),
h AS (
  SELECT page_id, first_id, p.body, sha1(p.body) AS hex FROM p JOIN f USING (body))
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 CAST((CAST('0x' || substr(hex, 1 + 10 * g, 10) AS BIGINT) >> (5 * (7 - j))) & 31 AS INT) + 1, 1),
                 '' ORDER BY g, j)
        FROM range(4) a(g), range(8) b(j)) AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM h
"""

ORACLE = {"op4_quality_rules": OP4, "op5_warc": OP5}
