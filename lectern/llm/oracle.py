"""DuckDB SQL for the operators that SQL can express over whole tables."""

from __future__ import annotations

OP10 = r"""
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, s, s + least(10, len(w)) - 1), ' ') AS win, least(10, len(w)) AS n
  FROM iw, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT rid, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win
  FROM dw, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS s)),
hit AS (SELECT DISTINCT p.rid, p.s, p.n, win.item_id FROM pos p JOIN win ON p.win = win.win AND p.n = win.n),
words AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS k FROM hit) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

OP4 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, s, array_to_string(list_slice(w, s, s + 19), ' ') AS win
  FROM dw, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS s)),
later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM dw),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM dw LEFT JOIN kept USING (doc_id)
"""


#: crc32 of a decimal id, bit by bit: each digit comes in once and is followed by seven bare shifts.
CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: [CAST(ord(d) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))), 4294967295)"""

OP13 = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS r
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {CRC32} % 6 AS h, conv_id - conv_id % 100 AS head FROM (SELECT DISTINCT conv_id FROM turns)),
sizes AS (SELECT conv_id AS head, count(*) AS n FROM turns GROUP BY 1),
rebuilt AS (
  SELECT c.conv_id, t.r AS pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.head AND t.r < c.h
  UNION ALL
  SELECT c.conv_id, t.r - c.h + least(c.h, coalesce(n, 0)), role, text
  FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.r >= c.h LEFT JOIN sizes s ON s.head = c.head),
steps AS (
  SELECT conv_id, pos + 1 AS depth, length(text) AS tokens,
         sha256(string_agg(sha256(length(role) || ':' || role || text), '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS node
  FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM convs),
placed AS (
  SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM steps),
nodes AS (
  SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n, any_value(tokens) AS tokens,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM placed GROUP BY depth, node),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY 1),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (node)),
below AS (
  SELECT a.node, sum((w.n - 1) * w.tokens) AS saved, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS leaves
  FROM whole w JOIN placed a ON a.conv_id = w.conv_id AND a.depth <= w.depth GROUP BY 1)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, w.n AS n_convs, CAST(w.n_children AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, w.ends_sha256
FROM whole w LEFT JOIN nodes p ON p.node = w.parent JOIN below b ON b.node = w.node
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_substring": OP4, "op10_decontaminate": OP10, "op13_prefix_trie": OP13}
