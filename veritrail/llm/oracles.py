"""SQL of the queries that SQL can express, for the small tables."""

from __future__ import annotations

OP7 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
t AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
k AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM t) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM k) GROUP BY 1),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines, coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, CAST(n_words < 50 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS BIGINT) + 4 * CAST(10 * n_symbols > n_words AS BIGINT) + 8 * CAST(2 * n_dup_lines > n_lines AS BIGINT)
  + 16 * CAST(word_chars < 2 * n_words AS BIGINT) + 32 * CAST(word_chars > 20 * n_words AS BIGINT) AS fail_bits FROM m)
SELECT *, '2' AS policy, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM f
"""

OP5 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
x AS (SELECT doc_id, array_to_string(ws, ' ') AS line, ws FROM w),
k AS (SELECT line, min(doc_id) AS least, any_value(ws) AS ws FROM x WHERE len(ws) > 0 GROUP BY line),
s AS (SELECT DISTINCT least, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT least, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM k)),
n AS (SELECT least, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.least AS u, b.least AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.least <> b.least GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n a ON a.least = u JOIN n b ON b.least = v WHERE 100 * c >= 75 * (a.n + b.n - c)),
r(u, v) AS (SELECT least, least FROM n UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
c AS (SELECT u, min(v) AS component_id FROM r GROUP BY u)
SELECT x.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, x.doc_id) AS component_id, x.doc_id = coalesce(c.component_id, x.doc_id) AS kept
FROM x LEFT JOIN k USING (line) LEFT JOIN n ON n.least = k.least LEFT JOIN c ON c.u = k.least
"""

RULE_ABLATIONS = f"""
WITH f AS ({OP7}),
r AS (SELECT * FROM (VALUES ('1', 3, 'few_words', 1), ('1', 3, 'repeated_words', 2), ('2', 63, 'few_words', 1), ('2', 63, 'repeated_words', 2), ('2', 63, 'symbols', 4), ('2', 63, 'repeated_lines', 8), ('2', 63, 'short_words', 16), ('2', 63, 'long_words', 32)) AS t(version, mask, rule, bit))
SELECT version, rule, count(*) FILTER (fail_bits & mask <> 0) AS rejected, count(*) FILTER (fail_bits & bit <> 0) AS failed, count(*) FILTER (fail_bits & mask = bit) AS only FROM f CROSS JOIN r GROUP BY ALL
"""
