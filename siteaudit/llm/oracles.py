"""DuckDB SQL for the queries that SQL can express. The others need a learned model, a tokenizer, a
seeded XXH64 or a byte-wise digest, which DuckDB does not have; tests hold those against plain
versions."""

from __future__ import annotations

from siteaudit.llm.url_filter import RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rules() -> str:
    return ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)


_OP3 = f"""WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS host, coalesce(rest, '') AS rest FROM a),
c AS (SELECT page_id, translate(host, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM b),
r(verdict, rule, rule_host, rule_path) AS (VALUES {_rules()}),
m AS (SELECT c.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY c.page_id ORDER BY length(r.rule) DESC, length(r.rule_host) DESC) AS nth FROM c JOIN r ON (c.host = r.rule_host OR c.host LIKE concat('%.', r.rule_host)) AND starts_with(c.path, r.rule_path))
SELECT c.page_id, c.host, c.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM c LEFT JOIN m ON m.page_id = c.page_id AND m.nth = 1"""

_WORDS = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_OP4 = f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
i AS MATERIALIZED (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL),
w AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, k, k + n - 1), ' ') AS win FROM (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM i WHERE len(ws) > 0) x),
lens AS (SELECT DISTINCT n FROM w),
p AS MATERIALIZED (SELECT doc_id, n, k, array_to_string(list_slice(ws, k, k + n - 1), ' ') AS win FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, lens WHERE len(ws) >= n) x),
h AS MATERIALIZED (SELECT p.doc_id, p.k, p.n, w.item_id FROM p JOIN w ON w.n = p.n AND w.win = p.win),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM h) x GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS varchar) AS item FROM h) x GROUP BY 1)
SELECT d.doc_id, CAST(len(d.ws) AS bigint) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items, sha256(coalesce(items.listed, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""

#: CRC-32 of a decimal, bit by bit over its ASCII bytes.
_BYTES = "list_transform(string_split(CAST(c AS varchar), ''), lambda b: CAST(ascii(b) AS bigint))"
_CRC = f"xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
_OP11 = f"""WITH o AS MATERIALIZED (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT c, ts, c - c % 20 AS base, CAST({_CRC} % 4 AS bigint) AS h FROM o),
p AS MATERIALIZED (SELECT h.c, list_concat(coalesce(list_slice(b.ts, 1, h.h), []), list_slice(h.ts, h.h + 1, len(h.ts))) AS path FROM h LEFT JOIN o b ON b.c = h.base),
m AS MATERIALIZED (SELECT c, path, unnest(range(0, len(path) + 1)) AS depth FROM p),
k AS MATERIALIZED (SELECT c, depth, path, sha256(CAST(list_slice(path, 1, depth) AS varchar)) AS node, CASE WHEN depth > 0 THEN sha256(CAST(list_slice(path, 1, depth - 1) AS varchar)) END AS up FROM m),
n AS MATERIALIZED (SELECT depth, node, min(up) AS up, min(c) AS conv_id, count(*) AS n_convs, CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(min(path[depth].t), '[^\\x20\\x09-\\x0D]+')) END AS words,
 sha256(coalesce(string_agg(CASE WHEN len(path) = depth THEN CAST(c AS varchar) END, ',' ORDER BY c), '')) AS ends_sha256 FROM k GROUP BY depth, node),
kids AS (SELECT depth - 1 AS depth, up AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
a AS (SELECT t.depth, t.node, sum((n.n_convs - 1) * n.words) AS saved, count(*) FILTER (WHERE kids.n_children IS NULL) AS n_leaves FROM n JOIN k s ON s.c = n.conv_id AND s.depth = n.depth JOIN k t ON t.c = s.c AND t.depth <= s.depth LEFT JOIN kids ON kids.depth = n.depth AND kids.node = n.node GROUP BY 1, 2)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n_children, 0) AS n_children, a.n_leaves, CAST(a.saved AS bigint) AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN n q ON q.depth = n.depth - 1 AND q.node = n.up LEFT JOIN kids ON kids.depth = n.depth AND kids.node = n.node JOIN a ON a.depth = n.depth AND a.node = n.node"""

ORACLES: dict[str, str] = {"op3_digest_array": _OP3, "op4_prefix_join": _OP4, "op11_louds_trie": _OP11}
