"""DuckDB SQL for the queries that SQL can express; it takes its own way to the same rows."""

from __future__ import annotations

from tarnflow.llm import secrets

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
s AS (SELECT item_id, least(10, len(w)) AS n, w FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS words FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM s)),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS words FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM s))),
hit AS (SELECT doc_id, item_id, n, p FROM dw JOIN bw USING (n, words)),
at_ AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY 1),
who AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN at_ USING (doc_id) LEFT JOIN who USING (doc_id)
"""


def _found(pattern: str, group: int) -> str:
    """Matches as structs of start, end and the group, from the pieces between them."""
    p = pattern.replace("'", "''")
    text = "coalesce(text, '')"
    return f"""list_transform(range(1, len(regexp_extract_all({text}, '{p}')) + 1), lambda i: {{'s': list_sum(list_transform(string_split_regex({text}, '{p}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all({text}, '{p}')[1:i - 1], lambda x: length(x))), 0),
 'm': regexp_extract_all({text}, '{p}')[i], 'g': regexp_extract_all({text}, '{p}', {group})[i]}})"""


def _secrets() -> str:
    kinds = " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS kind, {k} AS k, unnest({_found(pattern, group)}) AS x, {least} AS least FROM documents" for k, (kind, pattern, group, least) in enumerate(secrets.BASE))
    allowed = " OR ".join("regexp_matches(t, '" + p + "')" for p in secrets.ALLOWED)
    hexes, mixed, other = (bits for *_, bits in secrets.CLASSES)
    return f"""
WITH b AS (SELECT doc_id, kind, k, x.s AS s, x.s + length(x.m) AS e FROM ({kinds}) WHERE length(x.g) >= least),
c AS (SELECT doc_id, x.s AS s, x.s + length(x.m) AS e, x.m AS t FROM (SELECT doc_id, unnest({_found(secrets.CANDIDATE, 0)}) AS x FROM documents) WHERE regexp_matches(x.m, '[0-9]') AND regexp_matches(x.m, '[A-Za-z]')),
f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = c.doc_id AND b.s <= c.s AND c.e <= b.e) AND NOT ({allowed})),
w AS (SELECT doc_id, s, e, t, substr(t, p, {secrets.WINDOW}) AS w FROM (SELECT *, unnest(range(1, length(t) - {secrets.WINDOW} + 2)) AS p FROM f)),
h AS (SELECT doc_id, s, e, t, max(list_sum(list_transform(list_distinct(string_split(w, '')), lambda ch: -(length(w) - length(replace(w, ch, ''))) / {secrets.WINDOW}.0 * log2((length(w) - length(replace(w, ch, ''))) / {secrets.WINDOW}.0)))) AS bits FROM w GROUP BY ALL),
y AS (SELECT doc_id, 'entropy' AS kind, 3 AS k, s, e FROM h WHERE bits >= CASE WHEN regexp_matches(t, '^[0-9A-Fa-f]+$') THEN {hexes} WHEN regexp_matches(t, '[A-Z]') AND regexp_matches(t, '[a-z]') THEN {mixed} ELSE {other} END),
n AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS j FROM b GROUP BY 1),
z AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS j FROM (SELECT doc_id, kind, k, s, e FROM b UNION ALL SELECT * FROM y) GROUP BY 1)
SELECT doc_id, coalesce(n.a, 0) AS n_assign, coalesce(n.c, 0) AS n_access, coalesce(n.h, 0) AS n_hex, sha256(coalesce(n.j, '')) AS base_sha256, coalesce(z.j, '') AS spans FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN z USING (doc_id)
"""


SECRETS = _secrets()

# Hyperplanes find a pair at the threshold in one of the tables with probability 0.9997; the SQL compares all pairs of a label.
EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0),
u AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r(vec_id, component) USING KEY (vec_id) AS (SELECT vec_id, vec_id FROM embeddings UNION (SELECT q.vec_id, min(r.component) FROM recurring.r AS q JOIN l ON l.b = q.vec_id JOIN r ON r.vec_id = l.a GROUP BY q.vec_id HAVING min(r.component) < any_value(q.component)))
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = r.vec_id) AS n_links, component AS component_id, vec_id = component AS kept FROM r
"""

_TOKENS = r"regexp_extract_all(body, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+')"

INFILL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents),
h AS (SELECT *, {_TOKENS} AS t, len({_TOKENS}) AS n, ('0x' || hex[1:8])::BIGINT AS h1, ('0x' || hex[9:16])::BIGINT AS h2, ('0x' || hex[17:24])::BIGINT AS h3, ('0x' || hex[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(t[1:a], ''), '') AS prefix, coalesce(array_to_string(t[a + 1:b], ''), '') AS middle, coalesce(array_to_string(t[b + 1:n], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(body) AS restored_sha256
FROM p
"""
