"""DuckDB SQL of those contract queries that SQL can express."""

from __future__ import annotations

from .secrets import BASE, RULES, Rule

NEAREST = """
WITH good AS (SELECT vec_id, min(embedding::DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id),
size AS (SELECT len(v) AS n FROM good GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
usable AS (SELECT vec_id, v FROM good, size WHERE len(v) = n),
scored AS (SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(x.v, q.v) AS score FROM usable q JOIN usable x ON x.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored QUALIFY rank <= 20
"""

NEAR_TEXTS = r"""
WITH RECURSIVE texts AS (SELECT text, min(doc_id) AS text_id, count(*) AS n_copies FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) GROUP BY text),
words AS (SELECT text_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM texts),
places AS (SELECT text_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0),
shingles AS (SELECT DISTINCT text_id, array_to_string(w[i:i + 4], ' ') AS s FROM places),
sizes AS (SELECT text_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT a.text_id AS x, b.text_id AS y, count(*) AS c FROM shingles a JOIN shingles b USING (s) WHERE a.text_id < b.text_id GROUP BY 1, 2),
near AS (SELECT x, y FROM shared JOIN sizes p ON p.text_id = x JOIN sizes q ON q.text_id = y WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9),
links AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
reached(x, y) AS (SELECT text_id, text_id FROM texts UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y),
classes AS (SELECT x AS text_id, min(y) AS class_id FROM reached GROUP BY 1),
linked AS (SELECT x AS text_id, sum(n_copies)::BIGINT AS copies, count(*) AS n FROM links JOIN texts ON texts.text_id = y GROUP BY 1)
SELECT doc_id, class_id, t.text_id, n_copies, coalesce(copies, 0) + n_copies - 1 AS n_links, coalesce(n, 0) AS n_text_links
FROM documents d JOIN texts t ON t.text = coalesce(d.text, '') JOIN classes c ON c.text_id = t.text_id LEFT JOIN linked l ON l.text_id = t.text_id
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _spans(number: int, rule: Rule) -> str:
    p = _quoted(rule.pattern)
    return f"""SELECT doc_id, {number} AS k, '{rule.kind}' AS kind, unnest(list_transform(m, lambda x: length(x))) AS m, unnest(list_transform(g, lambda x: length(x))) AS g,
unnest(list_transform(list_slice(b, 1, len(m)), lambda x: length(x))) AS b, generate_subscripts(m, 1) AS i, {rule.least} AS least
FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {rule.group}) AS g, regexp_split_to_array(text, {p}) AS b FROM documents)"""


def secret_spans(rules: tuple[Rule, ...] = RULES) -> str:
    """Spans of all rules: positions add up from the pieces between matches and the matches."""
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{r.kind}" for k, r in enumerate(rules[:BASE]))
    return f"""
WITH hits AS ({" UNION ALL ".join(_spans(k, r) for k, r in enumerate(rules))}),
placed AS (SELECT *, sum(b + m) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM hits),
spans AS (SELECT doc_id, k, (e - m)::INT AS s, e::INT AS e, kind || ':' || (e - m)::INT || ':' || e::INT AS span FROM placed WHERE g >= least),
listed AS (SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY s, k, e) FILTER (k < {BASE}) AS base, string_agg(span, ',' ORDER BY s, k, e) AS spans, count(*) AS n FROM spans GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in rules[:BASE])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n, 0) AS n_spans
FROM documents LEFT JOIN listed USING (doc_id)
"""


SQL = {"op1_nearest": NEAREST, "op3_ngram_join": NEAR_TEXTS, "op9_secrets": secret_spans()}
