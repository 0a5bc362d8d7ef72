"""Results of the queries in SQL, by plain ways: all pairs that share a shingle, all windows, all turns."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words(x: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({x}, ''), '{_UPPER}', '{_UPPER.lower()}'), '{pattern}')"


_GAPS = "[^\\x20\\x09-\\x0D]+"
_LETTERS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words('text', _GAPS)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) END AS s FROM d),
n AS (SELECT doc_id, len(s) AS n FROM s), p AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM p a JOIN p b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT reach.doc_id, u.y FROM reach JOIN u ON reach.seen = u.x),
r AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, r.component_id, n.doc_id = r.component_id AS kept FROM n JOIN r USING (doc_id)
"""

DECONTAMINATION = f"""
WITH dw AS (SELECT doc_id, {_words('text', _LETTERS)} AS w FROM documents), iw AS (SELECT item_id, {_words('text', _LETTERS)} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, unnest([array_to_string(w[i:i + 9], ' ') for i in range(1, greatest(1, len(w) - 9) + 1)]) AS t FROM iw WHERE len(w) > 0),
lens AS (SELECT DISTINCT l FROM win),
dp AS (SELECT doc_id, l, unnest([{{'s': i, 't': array_to_string(w[i:i + l - 1], ' ')}} for i in range(1, len(w) - l + 2)]) AS p FROM dw, lens WHERE len(w) >= l),
h AS (SELECT doc_id, p.s AS s, dp.l AS l, item_id FROM dp JOIN win ON dp.l = win.l AND dp.p.t = win.t),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS q FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM h) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def _escaped(x: str) -> str:
    return f"(length({x}) + " + " + ".join(f"length({x}) - length(replace({x}, chr({c}), ''))" for c in (92, 60, 91)) + ")"


_TOLD = "'</s>[INST] ok [/INST]'"
CHAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', {_TOLD}), (-1, 1, 'assistant', {_TOLD})))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
sum(17 + {_escaped('role')} + length(role) - length(replace(role, chr(10), '')) + {_escaped('text')})::BIGINT AS formatted_chars, false AS rewrites_history FROM t GROUP BY conv_id
"""

ORACLE_SQL = {"op1_near_duplicates": NEAR_DUPLICATES, "op4_decontamination": DECONTAMINATION, "op10_chat_formatting": CHAT}
