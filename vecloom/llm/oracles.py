"""SQL for DuckDB of the queries that SQL can express."""

from __future__ import annotations

import string

from vecloom.llm.secrets import BASE_RULES, MORE_RULES

_LOW = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_ALNUM_WORDS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_WORDS = f"regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+')"


def decontaminate(window: int, near: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_ALNUM_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, w[i:i + {window - 1}] AS g FROM b, unnest(range(1, greatest(len(w) - {window - 1}, 1) + 1)) AS t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT len(g) AS n FROM win),
occ AS (SELECT doc_id, i, n, w[i:i + n - 1] AS g FROM d, lens, unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS (SELECT DISTINCT doc_id, i, n, item FROM occ JOIN win USING (g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id),
freq AS (SELECT t, count(*) AS c FROM (SELECT unnest(w) AS t FROM d) GROUP BY t),
placed AS (SELECT g, i - 1 AS o, g[i] AS t FROM (SELECT DISTINCT g FROM win), unnest(range(1, len(g) + 1)) AS u(i)),
anchor AS (SELECT g, a.t AS t FROM (SELECT g, min({{'c': c, 'o': o, 't': t}}) AS a, count(DISTINCT t) AS present FROM placed JOIN freq USING (t) GROUP BY g) WHERE present >= least({near}, len(list_distinct(g)))),
post AS (SELECT doc_id, w[i] AS t, w[greatest(i - {window - 1}, 1):i + {window - 1}] AS around FROM d, unnest(range(1, len(w) + 1)) AS t(i) WHERE w[i] IN (SELECT t FROM anchor)),
near AS (SELECT DISTINCT doc_id, item FROM post JOIN anchor USING (t) JOIN win USING (g) WHERE len(list_intersect(g, around)) >= least({near}, len(list_distinct(g)))),
nrs AS (SELECT doc_id, count(*) AS n_near_items FROM (SELECT doc_id, item FROM near EXCEPT SELECT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN nrs USING (doc_id)"""


def ngram_join(words: int, percent: int) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= {words} THEN list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' '))
WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= {percent} * (p.n + q.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)"""


def find_secrets() -> str:
    rules = BASE_RULES + MORE_RULES
    parts = []
    for k, r in enumerate(rules):
        p = "'" + r.regex.replace("'", "''") + "'"
        before = "coalesce(list_sum(list_transform({0}, lambda x: length(x))), 0)"
        span = f"{{'s': {before.format('g[1:j]')} + {before.format('m[1:j - 1]')}, 'n': length(m[j]), 'v': length(v[j])}}"
        parts.append(
            f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda j: {span})) AS x FROM "
            f"(SELECT doc_id, string_split_regex(text, {p}) AS g, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {r.group}) AS v FROM d WHERE regexp_matches(text, {p}))"
        )
    least = " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(rules))
    base = len(BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{r.kind}" for k, r in enumerate(BASE_RULES))
    text = "string_agg(kind || ':' || x.s::BIGINT || ':' || (x.s + x.n)::BIGINT, ',' ORDER BY x.s, k)"
    outer = ", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE_RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE x.v >= CASE k {least} END),
a AS (SELECT doc_id, {counts}, {text.replace(" ORDER BY x.s, k)", " ORDER BY x.s, k) FILTER (k < " + str(base) + ")")} AS base, {text} AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {outer}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""
