"""DuckDB SQL for the queries that SQL can express, on the tables as they are given.

The pages of the given tables keep their article in one element, so SQL can cut it out there; the operator itself knows
nothing of that. Models, searches over learnt structures and tokenizers have no SQL and are tested against brute force.
"""

from __future__ import annotations

OP3 = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
starts AS (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM base WHERE len(ws) >= 5),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i:i + 4]) AS met FROM starts),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM windows, range(5) t(k) WHERE met >= 2 GROUP BY r),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, len(list_aggregate(ws || [''], 'string_agg', ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines, len(regexp_extract_all(text, '\p{Lu}')) AS n_capitals
  FROM base LEFT JOIN repeated USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 3 * n_lines OR 10 * n_capitals > 3 * word_chars
            OR NOT word_chars BETWEEN 2 * n_words AND 15 * n_words) AS kept
FROM judged
"""

OP12 = r"""
WITH body AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS a FROM pages),
blocks AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(a, '</?(?:p|h1)>'), lambda b: trim(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      regexp_replace(b, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'),
      '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS b
  FROM body),
texts AS (SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10)) AS text FROM blocks)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts
"""


def _round(k: int) -> str:
    """Nearest entries of codebook k - 1, and codebook k from them."""
    sums = ", ".join(f"floor(sum(s[{i}])::DOUBLE / count(*))::BIGINT" for i in range(1, 5))
    return f"""{_assigned(k - 1)},
m{k} AS (SELECT p, e, [{sums}] AS s FROM a{k - 1} GROUP BY p, e),
b{k} AS (SELECT p, e, coalesce(m{k}.s, b{k - 1}.s) AS s FROM b{k - 1} LEFT JOIN m{k} USING (p, e))"""


def _assigned(k: int) -> str:
    far = " + ".join(f"(x.s[{i}] - b.s[{i}]) * (x.s[{i}] - b.s[{i}])" for i in range(1, 5))
    return f"""d{k} AS (SELECT x.vec_id, x.label, x.p, x.s, min(({far}) * 64 + b.e) AS de FROM parts x JOIN b{k} b USING (p)
  GROUP BY ALL),
a{k} AS (SELECT vec_id, label, p, s, de % 64 AS e, de // 64 AS error FROM d{k})"""


OP13 = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, p, v[p * 4 + 1:p * 4 + 4] AS s FROM kept, range(16) t(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, s FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
{_round(1)},
{_round(2)},
{_assigned(2)},
whole AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(error)::BIGINT AS error FROM a2
  GROUP BY vec_id, label),
book AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM whole, book
"""

ORACLE = {"op3_quality_rules": OP3, "op12_html_extraction": OP12, "op13_vector_codes": OP13}
