"""DuckDB SQL of the named queries, on the tables of the same names.

Words are matches of [\\p{L}\\p{N}_]+ in lower-cased text in both engines; positions start at 0.
"""

from __future__ import annotations

SQL: dict[str, str] = {}

SLICE = "(1929 + doc_id % 3)::INT"
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"

TOKENS = f"""
docs AS (SELECT doc_id, {SLICE} AS slice, lang, text FROM documents),
lists AS (SELECT doc_id, slice, {WORDS} AS l FROM docs),
tok AS (SELECT doc_id, slice, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS pos FROM lists)"""

SPACED = f"""
docs AS (SELECT doc_id, {SLICE} AS slice, text FROM documents),
spaced AS (SELECT doc_id, slice, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS l FROM docs),
raw AS (SELECT doc_id, slice, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS pos FROM spaced)"""

SEEDS = "seeds(term, category) AS (VALUES ('und','link'),('and','link'),('der','article'),('die','article'),('the','article'),('les','article'),('que','relative'))"
STEMS = "stems(term, category) AS (VALUES ('the','article'),('der','article'),('and','link'),('que','relative'),('ver','prefix'))"
STOP = "('the','of','and','to','in','der','die','und','de','la','que')"
WEIGHTS = "lexicon(word, weight) AS (VALUES ('the',-0.5::DOUBLE),('and',0.25),('der',-0.25),('que',0.5),('les',0.75),('in',-1.0))"
PPM = "CASE WHEN {t} > 0 THEN round({n} / {t} * 1e6, {d}) ELSE 0.0 END"


def ppm(n: str, t: str, d: int = 2) -> str:
    return PPM.format(n=n, t=t, d=d)


SQL["freq_overall"] = f"""WITH {TOKENS}, n AS (SELECT count(*) AS t FROM tok)
SELECT token, count(*) AS abs, {ppm("count(*)", "any_value(t)")} AS per_million FROM tok, n GROUP BY token"""

BY_SLICE = f"""{TOKENS}, sizes AS (SELECT slice, count(*) AS t FROM tok GROUP BY 1),
freq AS (SELECT slice, token, count(*) AS abs, {ppm("count(*)", "any_value(t)")} AS per_million FROM tok JOIN sizes USING (slice) GROUP BY slice, token)"""

SQL["freq_by_slice"] = f"WITH {BY_SLICE} SELECT *, row_number() OVER (PARTITION BY slice ORDER BY abs DESC, token) AS rank FROM freq QUALIFY rank <= 20"

SQL["freq_scope_gsets"] = f"""WITH {TOKENS}, cut AS (SELECT CASE WHEN doc_id % 7 <> 0 THEN slice END AS slice, token FROM tok),
both_ AS (SELECT 'gesamt' AS scope, token FROM cut UNION ALL SELECT slice::VARCHAR, token FROM cut WHERE slice IS NOT NULL),
sizes AS (SELECT scope, count(*) AS t FROM both_ GROUP BY 1)
SELECT scope, token, count(*) AS abs, {ppm("count(*)", "any_value(t)")} AS per_million FROM both_ JOIN sizes USING (scope) GROUP BY scope, token"""

OVERVIEW = f"""{TOKENS}, sizes AS (SELECT slice, count(*) AS n_docs, sum(len(l))::BIGINT AS n_tokens FROM lists GROUP BY 1),
types AS (SELECT slice, count(DISTINCT token) AS n_types FROM tok GROUP BY 1)"""
SQL["corpus_overview"] = f"WITH {OVERVIEW} SELECT slice, n_docs, n_tokens, n_tokens AS n_raw_tokens, n_types, (n_tokens // n_docs) AS tokens_per_doc FROM sizes JOIN types USING (slice)"
SQL["rollup_total"] = f"""WITH {OVERVIEW}, x AS (SELECT slice::VARCHAR AS slice, n_docs, n_tokens, n_types FROM sizes JOIN types USING (slice))
SELECT * FROM x UNION ALL SELECT 'GESAMT', sum(n_docs)::BIGINT, sum(n_tokens)::BIGINT, sum(n_types)::BIGINT FROM x"""

SQL["corpus_filtered"] = f"""WITH {TOKENS}, kept AS (SELECT doc_id, slice, len(l) AS n_raw_tokens,
list_filter(l, lambda t: length(t) >= 4 AND regexp_full_match(t, '\\p{{L}}+') AND t NOT IN {STOP}) AS k FROM lists)
SELECT doc_id, slice, len(k) AS n_tokens, n_raw_tokens, md5(array_to_string(k, ',')) AS tokens_md5 FROM kept"""

SQL["corpus_lemmatized"] = f"""WITH {TOKENS} SELECT doc_id, len(l) AS n_tokens, md5(array_to_string(list_transform(l, lambda t:
CASE t WHEN 'der' THEN 'die' WHEN 'das' THEN 'die' WHEN 'les' THEN 'le' WHEN 'is' THEN 'be' WHEN 'was' THEN 'be' ELSE t END), ',')) AS tokens_md5 FROM lists"""

GRID = f"""{BY_SLICE}, {SEEDS}, grid AS (SELECT s.slice::INT AS slice, term, category, coalesce(abs, 0) AS abs, coalesce(per_million, 0.0) AS per_million
FROM seeds CROSS JOIN (VALUES (1929), (1930), (1931)) s(slice) LEFT JOIN freq ON freq.slice = s.slice AND freq.token = term)"""
PIVOT = "sum(abs) FILTER (slice = 1929)::BIGINT AS y1929, sum(abs) FILTER (slice = 1930)::BIGINT AS y1930, sum(abs) FILTER (slice = 1931)::BIGINT AS y1931"
SQL["seed_grid"] = f"WITH {GRID} SELECT * FROM grid"
SQL["seed_pivot"] = f"WITH {GRID} SELECT term, category, {PIVOT} FROM grid GROUP BY 1, 2"
SQL["seed_category_sums"] = f"WITH {GRID} SELECT slice, category, sum(abs)::BIGINT AS abs, count(*) FILTER (abs > 0) AS n_terms FROM grid GROUP BY 1, 2"
SQL["pivot_mean"] = f"""WITH {GRID} SELECT category, round(avg(abs) FILTER (slice = 1929), 4) AS y1929, round(avg(abs) FILTER (slice = 1930), 4) AS y1930,
round(avg(abs) FILTER (slice = 1931), 4) AS y1931 FROM grid GROUP BY 1"""


def change(before: str, after: str) -> str:
    return f"""CASE WHEN {before} = 0 AND {after} = 0 THEN 'n/a' WHEN {before} = 0 THEN '∞' WHEN {before} = {after} THEN '±0%'
ELSE printf('%+.1f', ({after} - {before}) / ({before})::DOUBLE * 100) || '%' END"""


SQL["change_labels"] = f"""WITH {GRID}, p AS (SELECT term, {PIVOT} FROM grid GROUP BY 1)
SELECT term, {change("y1929", "y1930")} AS change_a, {change("0 * y1929", "y1931")} AS change_b FROM p"""

STEMMED = f"""{TOKENS}, {STEMS}, sizes AS (SELECT slice, count(*) AS n_tokens FROM tok GROUP BY 1),
hits AS (SELECT doc_id, slice, term, token FROM tok JOIN stems ON starts_with(token, term)),
counts AS (SELECT slice, term, count(*) AS abs, count(DISTINCT doc_id) AS n_docs FROM hits GROUP BY 1, 2),
forms AS (SELECT slice, term, token, count(*) AS n, row_number() OVER (PARTITION BY slice, term ORDER BY count(*) DESC, token) AS r FROM hits GROUP BY 1, 2, 3),
listed AS (SELECT slice, term, string_agg(token || '(' || n || ')', ', ' ORDER BY r) AS top_forms FROM forms WHERE r <= 5 GROUP BY 1, 2)"""
SQL["regex_freq"] = f"""WITH {STEMMED} SELECT slice, term, category, coalesce(abs, 0) AS abs, {ppm("coalesce(abs, 0)", "n_tokens", 1)} AS per_million, n_tokens,
coalesce(n_docs, 0) AS n_docs, coalesce(top_forms, '') AS top_forms FROM sizes CROSS JOIN stems LEFT JOIN counts USING (slice, term) LEFT JOIN listed USING (slice, term)"""
SQL["coverage_pivot"] = f"""WITH {STEMMED}, n AS (SELECT slice, count(*) AS n FROM docs GROUP BY 1),
x AS (SELECT slice, term, coalesce(abs, 0) AS a, coalesce(n_docs, 0) || '/' || n AS d FROM n CROSS JOIN stems LEFT JOIN counts USING (slice, term))
SELECT term, any_value(a) FILTER (slice = 1929) AS abs_1929, any_value(d) FILTER (slice = 1929) AS docs_1929, any_value(a) FILTER (slice = 1930) AS abs_1930,
any_value(d) FILTER (slice = 1930) AS docs_1930, any_value(a) FILTER (slice = 1931) AS abs_1931, any_value(d) FILTER (slice = 1931) AS docs_1931 FROM x GROUP BY 1"""
SQL["lookahead_count"] = f"WITH {TOKENS} SELECT slice, count(*) FILTER (token LIKE 'the%' AND token NOT LIKE 'ther%') AS n FROM tok GROUP BY 1"
SQL["method_comparison"] = f"""WITH {STEMMED}, map(stem, token) AS (VALUES ('the','the'),('the','then'),('der','der'),('que','que'),('ver','ver')),
t AS (SELECT slice, stem, count(*) AS n FROM tok JOIN map USING (token) GROUP BY 1, 2),
x AS (SELECT s.slice, st.term AS stem, coalesce(abs, 0) AS n_pattern, coalesce(t.n, 0) AS n_terms FROM sizes s CROSS JOIN stems st LEFT JOIN counts c ON c.slice = s.slice AND c.term = st.term
LEFT JOIN t ON t.slice = s.slice AND t.stem = st.term WHERE st.term IN (SELECT stem FROM map))
SELECT slice, stem, n_pattern, n_terms, {change("n_terms", "n_pattern")} AS change FROM x"""

_matrix = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS \"{t}\", {ppm(f'''len(list_filter(w, lambda x: x = '{t}'))''', 'len(w)')} AS \"{t}_ppm\"" for t in ("und", "and", "der", "die", "the", "les", "que"))
SQL["doc_seed_matrix"] = f"WITH d AS (SELECT doc_id, {SLICE} AS slice, regexp_extract_all(lower(text), '[a-zäöüß]+') AS w FROM documents) SELECT doc_id, slice, len(w) AS n_words, {_matrix} FROM d"
SQL["stopword_anti"] = f"WITH {TOKENS} SELECT token, count(*) AS abs FROM tok WHERE token NOT IN {STOP} GROUP BY 1"
SQL["default_category"] = f"WITH {TOKENS}, {SEEDS}, c AS (SELECT token AS term, count(*) AS abs FROM tok GROUP BY 1) SELECT term, abs, coalesce(category, 'other') AS category FROM c LEFT JOIN seeds USING (term)"
SQL["union_parts"] = f"WITH {BY_SLICE} SELECT 's' || slice AS part, token, abs, per_million FROM freq QUALIFY row_number() OVER (PARTITION BY slice ORDER BY abs DESC, token) <= 5"
SQL["doc_dedupe"] = "SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, md5(text) AS text_md5 FROM documents GROUP BY text"
SQL["vocabulary_sets"] = f"""WITH {TOKENS}, v AS (SELECT DISTINCT slice, token FROM tok), a AS (SELECT token FROM v WHERE slice = 1929), b AS (SELECT token FROM v WHERE slice = 1930),
n AS (SELECT (SELECT count(*) FROM (SELECT token FROM a UNION SELECT token FROM b)) AS n_union, (SELECT count(*) FROM a JOIN b USING (token)) AS n_both, (SELECT count(*) FROM a) AS n_a)
SELECT n_union, n_both, n_a - n_both AS n_only_a, round(n_both / n_union, 4) AS jaccard FROM n"""

LL = """2 * ((CASE WHEN {a} = 0 OR {r1} * {c1} / {n} = 0 THEN 0.0 ELSE {a} * ln({a} / ({r1} * {c1} / {n})) END) + (CASE WHEN {b} = 0 OR {r1} * {c2} / {n} = 0 THEN 0.0 ELSE {b} * ln({b} / ({r1} * {c2} / {n})) END)
+ (CASE WHEN {c} = 0 OR {r2} * {c1} / {n} = 0 THEN 0.0 ELSE {c} * ln({c} / ({r2} * {c1} / {n})) END) + (CASE WHEN {d} = 0 OR {r2} * {c2} / {n} = 0 THEN 0.0 ELSE {d} * ln({d} / ({r2} * {c2} / {n})) END))"""


def ll(a: str, b: str, c: str, d: str) -> str:
    a, b, c, d = (f"({x})::DOUBLE" for x in (a, b, c, d))
    return LL.format(a=a, b=b, c=c, d=d, r1=f"({a} + {b})", r2=f"({c} + {d})", c1=f"({a} + {c})", c2=f"({b} + {d})", n=f"({a} + {b} + {c} + {d})")


KEYNESS = f"""{TOKENS}, sizes AS (SELECT slice, count(*) AS t FROM tok GROUP BY 1), freq AS (SELECT slice, token, count(*) AS n FROM tok GROUP BY 1, 2),
pairs(transition, a, b) AS (VALUES ('1929→1930', 1929, 1930), ('1930→1931', 1930, 1931)),
w AS (SELECT transition, token, coalesce(sum(n) FILTER (slice = a), 0) AS abs_a, coalesce(sum(n) FILTER (slice = b), 0) AS abs_b, any_value(a) AS sa, any_value(b) AS sb
FROM freq JOIN pairs ON slice IN (a, b) GROUP BY 1, 2),
x AS (SELECT transition, token, abs_a, abs_b, ta.t AS ta, tb.t AS tb FROM w JOIN sizes ta ON ta.slice = sa JOIN sizes tb ON tb.slice = sb WHERE abs_a + abs_b >= 5),
g AS (SELECT *, {ll("abs_a", "abs_b", "ta - abs_a", "tb - abs_b")} AS raw, {ppm("abs_a", "ta")} AS pm_a, {ppm("abs_b", "tb")} AS pm_b FROM x),
s AS (SELECT *, round(CASE WHEN abs_a / (ta + 1e-9) >= abs_b / (tb + 1e-9) THEN raw ELSE -raw END, 4) + 0.0 AS g2 FROM g),
key AS (SELECT transition, token, abs_a::BIGINT AS abs_a, abs_b::BIGINT AS abs_b, pm_a, pm_b, round(pm_b - pm_a, 2) AS pm_diff, g2, CASE WHEN g2 > 0 THEN 'Absteiger' ELSE 'Aufsteiger' END AS direction FROM s)"""
SQL["keyness_pairs"] = f"WITH {KEYNESS} SELECT * FROM key"
SQL["keyness_ranked"] = f"""WITH {KEYNESS} SELECT transition, token, g2, direction, rank() OVER (PARTITION BY transition ORDER BY g2) AS rank_rising,
rank() OVER (PARTITION BY transition ORDER BY g2 DESC) AS rank_falling FROM key"""
SQL["keyness_strongest"] = f"WITH {KEYNESS} SELECT transition, direction, row_number() OVER (PARTITION BY transition, direction ORDER BY abs(g2) DESC, token) AS rank, token, g2 FROM key QUALIFY rank <= 10"

NGRAMS = f"""{TOKENS}, sizes AS (SELECT slice::VARCHAR AS scope, count(*) AS t FROM tok GROUP BY 1 UNION ALL SELECT 'gesamt', count(*) FROM tok),
led AS (SELECT slice, token AS a, lead(token) OVER w AS b, lead(token, 2) OVER w AS c FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT slice, 2 AS n, a || ' ' || b AS ngram FROM led WHERE b IS NOT NULL UNION ALL SELECT slice, 3, a || ' ' || b || ' ' || c FROM led WHERE c IS NOT NULL),
sc AS (SELECT 'gesamt' AS scope, n, ngram FROM g UNION ALL SELECT slice::VARCHAR, n, ngram FROM g),
ng AS (SELECT scope, ngram, n, count(*) AS abs, {ppm("count(*)", "any_value(t)")} AS per_million FROM sc JOIN sizes USING (scope) GROUP BY scope, ngram, n)"""
SQL["ngram_top"] = f"WITH {NGRAMS} SELECT *, row_number() OVER (PARTITION BY scope, n ORDER BY abs DESC, ngram) AS rank FROM ng WHERE scope = 'gesamt' QUALIFY rank <= 30"

SEEDED = f"""{NGRAMS}, {SEEDS}, parts AS (SELECT scope, ngram, n, abs, per_million, unnest(string_split(ngram, ' ')) AS term, generate_subscripts(string_split(ngram, ' '), 1) AS i FROM {{source}}),
first_ AS (SELECT scope, ngram, term, category, min(i) AS i FROM parts JOIN seeds USING (term) GROUP BY 1, 2, 3, 4),
terms_ AS (SELECT scope, ngram, string_agg(term, ', ' ORDER BY i) AS seed_terms FROM first_ GROUP BY 1, 2),
cats AS (SELECT scope, ngram, string_agg(category, ', ' ORDER BY i) AS category FROM (SELECT scope, ngram, category, min(i) AS i FROM first_ GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
SQL["ngram_by_slice"] = f"""WITH {NGRAMS.replace("ng AS (", "ng0 AS (")}, ng AS (SELECT *, row_number() OVER (PARTITION BY scope, n ORDER BY abs DESC, ngram) AS rank FROM ng0 WHERE scope <> 'gesamt' QUALIFY rank <= 30)
{SEEDED.replace("{source}", "ng")[len(NGRAMS):]}
SELECT ng.scope, ng.ngram, n, abs, per_million, rank, seed_terms IS NOT NULL AS has_seed, coalesce(seed_terms, '') AS seed_terms, coalesce(category, '') AS category
FROM ng LEFT JOIN terms_ USING (scope, ngram) LEFT JOIN cats USING (scope, ngram)"""
SEEDED_ALL = f"""{TOKENS}, {SEEDS}, sizes AS (SELECT slice::VARCHAR AS scope, count(*) AS t FROM tok GROUP BY 1 UNION ALL SELECT 'gesamt', count(*) FROM tok),
led AS (SELECT slice, token AS a, lead(token) OVER w AS b, lead(token, 2) OVER w AS c FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
hit AS (SELECT slice, a, b, c, x.category AS ca, y.category AS cb, z.category AS cc FROM led LEFT JOIN seeds x ON x.term = a LEFT JOIN seeds y ON y.term = b LEFT JOIN seeds z ON z.term = c WHERE b IS NOT NULL),
g AS (SELECT slice, 2 AS n, a || ' ' || b AS ngram, [CASE WHEN ca IS NOT NULL THEN a END, CASE WHEN cb IS NOT NULL THEN b END] AS t, [ca, cb] AS k FROM hit WHERE ca IS NOT NULL OR cb IS NOT NULL
UNION ALL SELECT slice, 3, a || ' ' || b || ' ' || c, [CASE WHEN ca IS NOT NULL THEN a END, CASE WHEN cb IS NOT NULL THEN b END, CASE WHEN cc IS NOT NULL THEN c END], [ca, cb, cc] FROM hit WHERE c IS NOT NULL AND (ca IS NOT NULL OR cb IS NOT NULL OR cc IS NOT NULL)),
n AS (SELECT slice, n, ngram, any_value(t) AS t, any_value(k) AS k, count(*) AS abs FROM g GROUP BY 1, 2, 3),
sc AS (SELECT slice::VARCHAR AS scope, n, ngram, t, k, abs FROM n UNION ALL SELECT 'gesamt', n, ngram, any_value(t), any_value(k), sum(abs)::BIGINT FROM n GROUP BY 2, 3),
first_ AS (SELECT *, list_filter(t, lambda x, i: x IS NOT NULL AND list_position(t, x) = i) AS tt, list_filter(k, lambda x, i: x IS NOT NULL AND list_position(k, x) = i) AS kk FROM sc),
seeded AS (SELECT scope, ngram, n, abs, {ppm("abs", "sizes.t")} AS per_million, array_to_string(tt, ', ') AS seed_terms, array_to_string(kk, ', ') AS category FROM first_ JOIN sizes USING (scope))"""
SQL["ngram_seeded"] = f"WITH {SEEDED_ALL} SELECT * FROM seeded"
SQL["ngram_category_pivot"] = f"""WITH {SEEDED_ALL} SELECT category, coalesce(sum(abs) FILTER (scope = '1929'), 0)::BIGINT AS y1929, coalesce(sum(abs) FILTER (scope = '1930'), 0)::BIGINT AS y1930,
coalesce(sum(abs) FILTER (scope = '1931'), 0)::BIGINT AS y1931 FROM seeded GROUP BY 1"""
SQL["bigram_pmi"] = f"""WITH {TOKENS}, led AS (SELECT token AS a, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM tok),
bi AS (SELECT a, b, count(*) AS n FROM led WHERE b IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5), u AS (SELECT token, count(*) AS n FROM tok GROUP BY 1), t AS (SELECT count(*) AS t FROM tok),
s AS (SELECT a AS word1, b AS word2, round(log2((bi.n / t) / ((x.n / t) * (y.n / t))), 4) AS pmi, bi.n AS abs FROM bi JOIN u x ON x.token = a JOIN u y ON y.token = b, t)
SELECT row_number() OVER (ORDER BY pmi DESC, abs DESC, word1, word2) AS rank, * FROM s QUALIFY rank <= 20"""

COLLOC = f"""{TOKENS}, hit AS (SELECT doc_id, slice, pos, token AS target FROM tok WHERE token IN ('the','der','que')),
near AS (SELECT h.slice, target, t.token AS collocate FROM hit h JOIN tok t ON t.doc_id = h.doc_id AND t.pos BETWEEN h.pos - 5 AND h.pos + 5 AND t.pos <> h.pos WHERE t.token <> target),
co AS (SELECT scope, target, collocate, count(*) AS cofreq FROM (SELECT 'gesamt' AS scope, target, collocate FROM near UNION ALL SELECT slice::VARCHAR, target, collocate FROM near) GROUP BY 1, 2, 3 HAVING count(*) >= 3),
u AS (SELECT scope, token, count(*) AS n FROM (SELECT 'gesamt' AS scope, token FROM tok UNION ALL SELECT slice::VARCHAR, token FROM tok) GROUP BY 1, 2), t AS (SELECT scope, sum(n)::BIGINT AS n_total FROM u GROUP BY 1),
j AS (SELECT co.scope, target, collocate, cofreq, x.n AS freq_target, y.n AS freq_collocate, n_total FROM co JOIN u x ON x.scope = co.scope AND x.token = target JOIN u y ON y.scope = co.scope AND y.token = collocate JOIN t ON t.scope = co.scope
WHERE x.n >= cofreq AND y.n >= cofreq AND n_total - x.n - y.n + cofreq >= 0),
col AS (SELECT *, round({ll("cofreq", "freq_target - cofreq", "freq_collocate - cofreq", "n_total - freq_target - freq_collocate + cofreq")}, 4) AS ll,
round(log2((cofreq / n_total) / ((freq_target / n_total) * (freq_collocate / n_total))), 4) AS pmi FROM j)"""
SQL["colloc_all"] = f"WITH {COLLOC} SELECT * FROM col"
SQL["colloc_ll"] = f"WITH {COLLOC} SELECT scope, target, row_number() OVER (PARTITION BY scope, target ORDER BY ll DESC, collocate) AS rank, collocate, cofreq, ll FROM col QUALIFY rank <= 20"
SQL["colloc_pmi"] = f"WITH {COLLOC} SELECT scope, target, row_number() OVER (PARTITION BY scope, target ORDER BY pmi DESC, collocate) AS rank, collocate, cofreq, pmi FROM col WHERE cofreq >= 5 QUALIFY rank <= 20"
SQL["colloc_year_compare"] = f"""WITH {COLLOC}, p AS (SELECT collocate, any_value(ll) FILTER (scope = '1929') AS y1929, any_value(ll) FILTER (scope = '1930') AS y1930, any_value(ll) FILTER (scope = '1931') AS y1931, count(*) AS n
FROM col WHERE target = 'der' AND scope <> 'gesamt' GROUP BY 1)
SELECT collocate, y1929, y1930, y1931, round(coalesce(y1929, 0) + coalesce(y1930, 0) + coalesce(y1931, 0), 3) AS total FROM p WHERE n >= 2 ORDER BY total DESC, collocate LIMIT 20"""
SQL["colloc_tagged"] = f"""WITH {SPACED}, x AS (SELECT doc_id, pos, regexp_replace(token, '[.,!?]+$', '') AS w FROM raw),
y AS (SELECT doc_id, pos, replace(lower(w), 'ſ', 's') AS w, CASE WHEN regexp_matches(w, '^[A-ZÄÖÜ]') THEN 'NOUN' WHEN length(w) > 3 THEN 'VERB' WHEN length(w) > 1 THEN 'DET' END AS p, lower(w) IN {STOP} AS s FROM x),
near AS (SELECT t.doc_id, t.pos, regexp_replace(t.w, '[^a-zäöüß]', '', 'g') AS collocate, t.p, t.s FROM y h JOIN y t ON t.doc_id = h.doc_id AND t.pos BETWEEN h.pos - 5 AND h.pos + 5 AND t.pos <> h.pos WHERE starts_with(h.w, 'ver')),
k AS (SELECT collocate, count(*) AS n, last(p ORDER BY doc_id, pos) AS pos_tag FROM near WHERE (p IS NULL OR p IN ('NOUN','VERB','ADJ','PROPN')) AND NOT s AND collocate <> '' AND NOT starts_with(collocate, 'ver') GROUP BY 1)
SELECT row_number() OVER (ORDER BY n DESC, collocate) AS rank, collocate, pos_tag, n, round(n / (SELECT sum(n) FROM k) * 100, 2) AS share FROM k QUALIFY rank <= 50"""

KWIC = f"""{SPACED}, hit AS (SELECT 'thing' AS target, doc_id, slice, pos, token FROM raw WHERE regexp_matches(token, '(?i)thing') UNION ALL SELECT 'ver', doc_id, slice, pos, token FROM raw WHERE regexp_matches(token, '^[Vv]er')),
k AS (SELECT target, slice, doc_id, token AS keyword, array_to_string(list_slice(l, greatest(pos - 29, 1), pos), ' ') AS "left", array_to_string(list_slice(l, pos + 2, pos + 31), ' ') AS "right", pos AS pos_in_doc FROM hit JOIN spaced USING (doc_id, slice))"""
SQL["kwic_hits"] = f"""WITH {KWIC} SELECT target, slice, doc_id, keyword, CASE WHEN pos_in_doc = 0 THEN '' ELSE "left" END AS "left", "right", (CASE WHEN pos_in_doc = 0 THEN '' ELSE "left" END) || '  [' || keyword || ']  ' || "right" AS concordance, pos_in_doc FROM k"""
SQL["kwic_stats"] = f"""WITH {KWIC}, p AS (SELECT target, count(*) FILTER (slice = 1929) AS n_1929, count(*) FILTER (slice = 1930) AS n_1930, count(*) FILTER (slice = 1931) AS n_1931 FROM k GROUP BY 1)
SELECT *, n_1929 + n_1930 + n_1931 AS total, CASE greatest(n_1929, n_1930, n_1931) WHEN n_1929 THEN 1929 WHEN n_1930 THEN 1930 ELSE 1931 END AS peak FROM p"""
SQL["kwic_search"] = f"""WITH {KWIC} SELECT doc_id, pos_in_doc, keyword FROM k WHERE target = 'thing' AND slice = 1930 AND ((pos_in_doc > 0 AND contains(lower("left"), 'ander')) OR contains(lower("right"), 'ander'))"""
SQL["kwic_meta_join"] = f"WITH {KWIC}, n AS (SELECT doc_id, count(*) AS n FROM k GROUP BY 1) SELECT doc_id, n, quality FROM n LEFT JOIN labels USING (doc_id)"

EDGES = """'.,;:!?"''()[]«»„“”–-'"""


def anchored(k: int) -> str:
    return f"""{SPACED}, win AS (SELECT slice, doc_id, pos, array_to_string(list_slice(l, greatest(pos + 1 - {k}, 1), pos + 1 + {k}), ' ') AS context FROM raw JOIN spaced USING (doc_id, slice)
WHERE regexp_full_match(trim(token, {EDGES}), '(?i)(the|der|les)'))"""


def hits(pattern: str) -> str:
    return f"sum(len(regexp_extract_all(context, '{pattern}')))::BIGINT"


SQL["window_cooccur"] = f"""WITH {anchored(15)}, c AS (SELECT slice, count(*) AS anchors, {hits("[aeiou]n")} AS vowels, {hits("[.,]")} AS marks, {hits("[A-Z]")} AS capitals FROM win GROUP BY 1)
SELECT *, round(vowels / greatest(anchors, 1) * 100, 2) AS vowels_norm, round(marks / greatest(anchors, 1) * 100, 2) AS marks_norm, round(capitals / greatest(anchors, 1) * 100, 2) AS capitals_norm FROM c"""
SQL["window_terms"] = f"""WITH {anchored(20)}, t AS (SELECT slice, 'vowels' AS term, {hits("[aeiou]n")} AS n FROM win GROUP BY 1 UNION ALL SELECT slice, 'marks', {hits("[.,]")} FROM win GROUP BY 1 UNION ALL SELECT slice, 'capitals', {hits("[A-Z]")} FROM win GROUP BY 1)
SELECT term, any_value(n) FILTER (slice = 1929) AS y1929, any_value(n) FILTER (slice = 1930) AS y1930, any_value(n) FILTER (slice = 1931) AS y1931 FROM t GROUP BY 1"""
CITED = f"""{anchored(20)}, c AS (SELECT slice, doc_id, pos, context, concat_ws('; ', CASE WHEN contains(context, 'ander') THEN 'ander' END, CASE WHEN contains(context, 'reti') THEN 'reti' END, CASE WHEN contains(context, 'enver') THEN 'enver' END) AS labels FROM win),
cited AS (SELECT * FROM c WHERE labels <> ''), each_ AS (SELECT *, unnest(string_split(labels, '; ')) AS label FROM cited)"""
SQL["window_citations"] = f"WITH {CITED} SELECT slice, doc_id, pos, labels, md5(context) AS context_md5 FROM cited"
SQL["citation_labels"] = f"WITH {CITED} SELECT label, count(*) AS n FROM each_ GROUP BY 1"
SQL["citation_first"] = f"WITH {CITED} SELECT slice, label, doc_id, pos FROM each_ QUALIFY row_number() OVER (PARTITION BY slice, label ORDER BY doc_id, pos) = 1"


def sentences(least: int) -> str:
    return f"""sp AS (SELECT doc_id, {SLICE} AS slice, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+([A-ZÄÖÜ])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > {least}) AS l FROM documents),
sent AS (SELECT doc_id, slice, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS pos FROM sp)"""


SQL["sentence_split"] = f"WITH {sentences(10)} SELECT slice, count(*) AS n, sum(length(sentence))::BIGINT AS chars FROM sent GROUP BY 1"
LEVELED = f"{sentences(10)}, lev AS (SELECT *, CASE WHEN contains(sentence, 'tion') THEN 3 WHEN contains(sentence, 'ing') THEN 2 WHEN contains(sentence, 'th') THEN 1 ELSE 0 END AS level FROM sent WHERE contains(sentence, 'an'))"
_levels = ", ".join(f"count(*) FILTER (level = {k}) AS s{k}, round(count(*) FILTER (level = {k}) / count(*) * 100, 1) AS s{k}_pct" for k in range(4))
SQL["level_by_slice"] = f"WITH {LEVELED} SELECT slice, count(*) AS total, {_levels} FROM lev GROUP BY 1"
SQL["level_examples"] = f"WITH {LEVELED} SELECT slice, level, row_number() OVER (PARTITION BY slice, level ORDER BY doc_id, pos) AS rank, doc_id, left(sentence, 280) AS sentence FROM lev QUALIFY rank <= 3"
POLAR = f"""{sentences(15)}, {WEIGHTS}, cut AS (SELECT doc_id, slice, pos, left(sentence, 500) AS s FROM sent WHERE contains(sentence, 'an')),
w AS (SELECT doc_id, slice, pos, unnest(regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM cut),
m AS (SELECT doc_id, pos, avg(weight) AS p FROM w JOIN lexicon USING (word) GROUP BY 1, 2), pol AS (SELECT doc_id, slice, pos, round(coalesce(p, 0.0), 6) AS polarity FROM cut LEFT JOIN m USING (doc_id, pos))"""
SQL["polarity_stats"] = f"""WITH {POLAR} SELECT slice, count(*) AS n, round(avg(polarity), 4) AS mean, round(median(polarity), 4) AS median, round(stddev_pop(polarity), 4) AS std, min(polarity) AS min, max(polarity) AS max,
round(count(*) FILTER (polarity < 0) / count(*) * 100, 2) AS share_neg, round(count(*) FILTER (polarity > 0) / count(*) * 100, 2) AS share_pos, round(count(*) FILTER (polarity = 0) / count(*) * 100, 2) AS share_neu FROM pol GROUP BY 1"""
SQL["polarity_extremes"] = f"WITH {POLAR} SELECT slice, row_number() OVER (PARTITION BY slice ORDER BY polarity, doc_id, pos) AS rank, doc_id, pos, polarity FROM pol QUALIFY rank <= 3"
DENSITY = f"""{WEIGHTS}, d AS (SELECT doc_id, {SLICE} AS slice, regexp_extract_all(lower(text), '[a-zäöüß]{{3,}}') AS w FROM documents),
h AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) JOIN lexicon USING (word) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS r FROM h),
s AS (SELECT doc_id, sum(n)::BIGINT AS n_hits, string_agg(word || '(' || n || ')', ', ' ORDER BY r) FILTER (r <= 5) AS top_words FROM r GROUP BY 1),
den AS (SELECT doc_id, slice, round(coalesce(n_hits, 0) / len(w) * 1000, 2) AS density, coalesce(n_hits, 0) AS n_hits, len(w) AS n_words, coalesce(top_words, '') AS top_words FROM d LEFT JOIN s USING (doc_id) WHERE len(w) > 0)"""
SQL["lexicon_density"] = f"WITH {DENSITY} SELECT * FROM den"
SQL["density_stats"] = f"WITH {DENSITY} SELECT slice::VARCHAR AS slice, count(*) AS n_docs, round(avg(density), 2) AS mean, min(density) AS min, max(density) AS max FROM den GROUP BY 1"
SQL["known_share"] = f"""WITH {TOKENS}, v AS (SELECT DISTINCT unnest({WORDS}) AS token FROM benchmark), h AS (SELECT doc_id, count(*) AS n FROM tok JOIN v USING (token) GROUP BY 1)
SELECT doc_id, len(l) AS n_words, CASE WHEN len(l) > 0 THEN round(coalesce(n, 0) / len(l) * 1.0, 4) ELSE 0.0 END AS score FROM lists LEFT JOIN h USING (doc_id)"""

SQL["tfidf_weights"] = f"""WITH {TOKENS}, c AS (SELECT doc_id, token AS term, count(*) AS tf FROM tok WHERE length(token) >= 2 GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM c, n GROUP BY term HAVING count(*) >= 3 AND count(*) <= 0.9 * any_value(n) ORDER BY total DESC, term LIMIT 5000),
w AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM c JOIN v USING (term), n), z AS (SELECT doc_id, sqrt(sum(w * w)) AS z FROM w GROUP BY 1)
SELECT doc_id, term, round(w / z, 5) AS weight FROM w JOIN z USING (doc_id)"""
SQL["tfidf_phrase"] = f"""WITH {anchored(20)}, k AS (SELECT slice, doc_id, pos, list_filter(regexp_extract_all(lower(context), '[\\p{{L}}\\p{{N}}_]+'), lambda t: t NOT IN {STOP}) AS l FROM win),
t AS (SELECT slice, doc_id, pos, unnest(l) AS a, generate_subscripts(l, 1) AS i FROM k), led AS (SELECT slice, doc_id, pos, a, lead(a) OVER w AS b, lead(a, 2) OVER w AS c FROM t WINDOW w AS (PARTITION BY doc_id, pos ORDER BY i)),
g AS (SELECT slice, doc_id, pos, a || ' ' || b AS term FROM led WHERE b IS NOT NULL UNION ALL SELECT slice, doc_id, pos, a || ' ' || b || ' ' || c FROM led WHERE c IS NOT NULL),
c AS (SELECT slice, doc_id, pos, term, count(*) AS tf FROM g GROUP BY ALL), n AS (SELECT count(*) AS n FROM k), v AS (SELECT term, count(*) AS df FROM c, n GROUP BY 1 HAVING count(*) >= 3 AND count(*) <= 0.85 * any_value(n)),
w AS (SELECT slice, doc_id, pos, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM c JOIN v USING (term), n), z AS (SELECT doc_id, pos, sqrt(sum(w * w)) AS z FROM w GROUP BY 1, 2),
m AS (SELECT slice, count(*) AS m FROM k GROUP BY 1), s AS (SELECT slice, term, round(sum(round(w / z, 12)) / any_value(m), 5) AS score FROM w JOIN z USING (doc_id, pos) JOIN m USING (slice) GROUP BY 1, 2)
SELECT slice, row_number() OVER (PARTITION BY slice ORDER BY score DESC, term) AS rank, term, score FROM s QUALIFY rank <= 20"""


def topic_terms(n: int, name: str) -> str:
    return f"""{name} AS (SELECT topic, list(term ORDER BY n DESC, term) AS terms FROM (SELECT (doc_id % {n})::INT AS topic, token AS term, count(*) AS n FROM tok WHERE length(token) >= 3 GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) <= 15) GROUP BY 1)"""


SQL["topic_jaccard"] = f"""WITH {TOKENS}, {topic_terms(5, "a")}, {topic_terms(7, "b")}, x AS (SELECT a.topic, b.topic AS best_topic, list_intersect(a.terms, b.terms) AS i, len(list_distinct(list_concat(a.terms, b.terms))) AS u FROM a CROSS JOIN b),
y AS (SELECT topic, best_topic, round(len(i) / u, 4) AS jaccard, array_to_string(list_sort(i), ', ') AS overlap FROM x) SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY topic ORDER BY jaccard DESC, best_topic) = 1"""
SHARES = "s AS (SELECT vec_id AS doc_id, (1929 + vec_id % 3)::INT AS slice, " + ", ".join(f"abs(embedding[{t + 1}]::DOUBLE) AS t{t}" for t in range(4)) + " FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) >= 4), d AS (SELECT *, CASE greatest(t0, t1, t2, t3) WHEN t0 THEN 0 WHEN t1 THEN 1 WHEN t2 THEN 2 ELSE 3 END AS dominant_topic, CASE WHEN t0 + t1 + t2 + t3 = 0 THEN 1 ELSE t0 + t1 + t2 + t3 END AS t FROM s)"
SQL["dominant_topic"] = f"WITH {SHARES} SELECT doc_id, dominant_topic FROM d"
SQL["topic_shares"] = f"WITH {SHARES} " + " UNION ALL ".join(f"SELECT slice, {t} AS topic, round(avg(t{t} / t), 4) AS mean_share, count(*) FILTER (dominant_topic = {t}) AS dominant_n_docs FROM d GROUP BY 1" for t in range(4))
SQL["inferred_topics"] = f"WITH {SHARES} " + " UNION ALL ".join(f"SELECT doc_id, {t} AS topic, round(t{t} / t, 6) AS p FROM d WHERE t{t} / t >= 0.3" for t in range(4))

SQL["section_lines"] = """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM l),
e AS (SELECT doc_id, pos, CASE WHEN regexp_matches(line, '^(The|Th|Der|La)') THEN 1 WHEN regexp_matches(line, '^(An|Die|Es|Re)') THEN 0 END AS e FROM x),
s AS (SELECT doc_id, pos, e, last_value(e IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM e)
SELECT doc_id, count(*) AS n, min(pos) AS first, max(pos) AS last FROM s WHERE s = 1 AND e IS NULL GROUP BY 1"""
SQL["bullet_names"] = "SELECT p_partkey, trim(p_name) AS a, trim(p_name) || '|' || trim(p_brand) AS b FROM part"
SQL["name_score"] = """WITH r AS (SELECT o_orderpriority AS name, 1 AS b, 0 AS r, NULL AS kind, o_orderkey AS k FROM orders WHERE o_custkey % 3 = 0 UNION ALL SELECT o_orderpriority, 0, 1, o_orderstatus, o_orderkey FROM orders WHERE o_custkey % 3 <> 0),
g AS (SELECT name, sum(b)::BIGINT AS n_bullets, sum(r)::BIGINT AS n_recognised, coalesce(arg_max(kind, k) FILTER (kind IS NOT NULL), '') AS kind FROM r GROUP BY 1), s AS (SELECT *, 2 * n_bullets + n_recognised AS score FROM g)
SELECT row_number() OVER (ORDER BY score DESC, name) AS rank, name, kind, score, n_bullets, n_recognised FROM s QUALIFY rank <= 50"""
SQL["name_clean"] = """SELECT c_custkey, CASE c_custkey % 12 WHEN 0 THEN c_name WHEN 8 THEN c_name || ' und Sohn' WHEN 10 THEN 'Hof (alt) ' || c_name WHEN 11 THEN nullif(c_name, 'Customer#000000011') END AS name FROM customer"""
SQL["section_entries"] = """WITH l AS (SELECT c_custkey % 7 AS doc_id, c_custkey AS pos, c_custkey % 50 AS k, c_name, c_mktsegment FROM customer),
e AS (SELECT *, CASE k WHEN 0 THEN 1 WHEN 40 THEN 0 END AS e FROM l), s AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM e),
n AS (SELECT doc_id, pos, unnest(CASE WHEN pos % 2 = 0 THEN [c_name, 'Haus ' || c_mktsegment] ELSE [c_name] END) AS name FROM s WHERE s = 1 AND e IS NULL) SELECT * FROM n"""
SQL["heading_extract"] = """SELECT DISTINCT ON (l_orderkey) 'f' || l_orderkey AS file, l_linenumber::INT AS page, 0 AS line_no, 'Handelsrat' AS text, CASE WHEN l_quantity / 2 >= 18 THEN 'haupttitel' WHEN l_quantity / 2 >= 12.5 THEN 'artikel' ELSE 'fallback' END AS kind
FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) ORDER BY l_orderkey, l_linenumber"""

FIXED = r"""x0 AS (SELECT doc_id, text AS t FROM documents), x1 AS (SELECT doc_id, replace(t, 'ae', 'ä') AS t, len(regexp_extract_all(t, 'ae')) AS n_0 FROM x0), x2 AS (SELECT doc_id, regexp_replace(t, 'th([.,])', 't\1', 'g') AS t, n_0, len(regexp_extract_all(t, 'th[.,]')) AS n_1 FROM x1),
x3 AS (SELECT doc_id, regexp_replace(t, '([0-9])[lI]', '\1', 'g') AS t, n_0, n_1, len(regexp_extract_all(t, '[0-9][lI]')) AS n_2 FROM x2), x4 AS (SELECT doc_id, t, n_0, n_1, n_2, len(regexp_extract_all(t, 'der')) AS n_3 FROM x3),
fixed AS (SELECT doc_id, replace(t, 'ss', 'ß') AS t, n_0, n_1, n_2, n_3, len(regexp_extract_all(t, 'ss')) AS n_4 FROM x4)"""
SQL["regex_fix"] = f"WITH {FIXED} SELECT doc_id, md5(t) AS text_md5, n_0, n_1, n_2, n_3, n_4 FROM fixed"
SQL["regex_fix_log"] = f"""WITH {FIXED}, s AS (SELECT unnest(['ae','th-end','one','same','ss']) AS label, unnest([sum(n_0), sum(n_1), sum(n_2), sum(n_3), sum(n_4)])::BIGINT AS n FROM fixed) SELECT * FROM s UNION ALL SELECT 'GESAMT', sum(n)::BIGINT FROM s"""
SQL["cer_pairs"] = r"""WITH p AS (SELECT doc_id::VARCHAR AS name, text AS r FROM documents) SELECT name, round((length(r) - length(replace(r, 'th', 't'))) / greatest(length(r), 1) * 100, 2) AS cer FROM p"""
SQL["changed_sentences"] = f"""WITH {FIXED}, cut AS (SELECT a.doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS b, string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS a FROM documents a JOIN fixed USING (doc_id)),
e AS (SELECT doc_id, unnest(b) AS before, unnest(a) AS after, generate_subscripts(b, 1) - 1 AS pos FROM cut) SELECT doc_id, pos, before, after FROM e WHERE before <> after AND before IS NOT NULL AND after IS NOT NULL AND len(list_filter(regexp_split_to_array(before, '\\s+'), lambda x: x <> '')) >= 5 ORDER BY doc_id, pos LIMIT 20"""

NAMED = """named AS (SELECT doc_id, CASE WHEN 1925 + doc_id % 20 BETWEEN 1920 AND 1939 AND doc_id % 7 <> 2 THEN (1925 + doc_id % 20)::INT END AS year, CASE WHEN doc_id % 7 IN (0, 1, 3, 6) THEN (doc_id % 40)::INT END AS issue FROM documents)"""
SQL["year_from_names"] = f"WITH {NAMED} SELECT * FROM named"
SQL["issue_table"] = f"""WITH {NAMED}, d AS (SELECT doc_id, year, issue, doc_id % 5 AS k, CASE doc_id % 5 WHEN 0 THEN DATE '1929-07-07' WHEN 1 THEN DATE '1930-04-28' WHEN 3 THEN DATE '1930-02-16' END AS day FROM named),
v AS (SELECT *, CASE WHEN year IS NULL OR abs(year(day) - year) <= 2 THEN day END AS found FROM d), p AS (SELECT conv_id AS doc_id, max(turn + 1) AS n_pages FROM conversations GROUP BY 1)
SELECT issue, year, CASE WHEN found IS NOT NULL THEN CASE k WHEN 0 THEN '7. Juli 1929' WHEN 1 THEN '28. April 1930' WHEN 3 THEN '16. Februar 1930' END END AS date, strftime(found, '%Y-%m-%d') AS date_iso,
CASE WHEN found IS NOT NULL THEN ['Montag','Dienstag','Mittwoch','Donnerstag','Freitag','Samstag','Sonntag'][isodow(found)] WHEN k = 0 THEN 'Sonntag' WHEN k = 2 THEN 'Samstag' END AS weekday, n_pages,
[5, 4, 2, 3, 4][k + 1] AS n_raw_tokens, [5, 4, 2, 3, 4][k + 1] AS n_tokens, doc_id, CASE WHEN issue <> 0 THEN year % 7 + issue / 4 END AS cer, CASE WHEN issue <> 0 AND year IS NOT NULL THEN issue::DOUBLE END AS wer FROM v LEFT JOIN p USING (doc_id)"""
SQL["slice_policies"] = f"""WITH d AS (SELECT CASE WHEN doc_id % 7 <> 0 THEN {SLICE} END AS s FROM documents) SELECT 'keep_null' AS policy, s::VARCHAR AS slice, count(*) AS n FROM d GROUP BY 2
UNION ALL SELECT 'default', coalesce(s, 1929)::VARCHAR, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'label', coalesce(s::VARCHAR, 'unbekannt'), count(*) FROM d GROUP BY 2 UNION ALL SELECT 'drop', s::VARCHAR, count(*) FROM d WHERE s IS NOT NULL GROUP BY 2"""
DAYS = "['Montag','Dienstag','Mittwoch','Donnerstag','Freitag','Samstag','Sonntag']"
SQL["date_extract"] = f"""WITH o AS (SELECT o_orderkey, (o_orderdate::DATE - INTERVAL 66 YEAR)::DATE AS day, o_orderkey % 8 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k < 6 THEN strftime(day, '%Y-%m-%d') END AS date_iso, CASE WHEN k < 6 THEN {DAYS}[isodow(day)] WHEN k = 6 THEN 'Samstag' END AS weekday FROM o"""
SQL["weekday"] = f"SELECT {DAYS}[isodow((o_orderdate::DATE - INTERVAL 66 YEAR)::DATE)] AS weekday, count(*) AS n FROM orders GROUP BY 1"
SQL["metadata_join"] = """WITH q AS (SELECT y AS year, i AS issue, y % 7 + i / 4 AS cer, i::DOUBLE AS wer FROM range(1990, 2010) a(y), range(4) b(i)), o AS (SELECT o_orderkey, year(o_orderdate)::INT AS year, (o_custkey % 5)::INT AS issue FROM orders)
SELECT o_orderkey, o.year, o.issue, cer, wer FROM o LEFT JOIN q ON q.year = o.year AND q.issue = o.issue AND o.issue <> 0"""
SQL["tiered_join"] = f"""WITH d AS (SELECT 'ausgabe-nummer-' || doc_id || CASE WHEN doc_id % 4 = 0 THEN '-2' ELSE '' END AS doc_id, {SLICE} AS year FROM documents),
f AS (SELECT '/in/' || doc_id || '.txt' AS path, CASE WHEN doc_id % 2 = 0 THEN {SLICE} END AS year, 'ausgabe-nummer-' || doc_id AS stem FROM documents WHERE doc_id % 3 <> 1),
t AS (SELECT d.doc_id, path, 1 AS tier FROM d JOIN f ON f.stem = d.doc_id AND f.year = d.year UNION ALL SELECT d.doc_id, path, 2 FROM d JOIN f ON f.stem = d.doc_id AND f.year IS NULL
UNION ALL SELECT d.doc_id, path, 3 FROM d JOIN f ON f.stem = regexp_replace(d.doc_id, '-\\d+$', '') AND f.stem <> d.doc_id UNION ALL SELECT d.doc_id, path, 4 FROM d JOIN f ON left(f.stem, 18) = left(d.doc_id, 18))
SELECT d.doc_id, d.year, path, tier FROM d LEFT JOIN (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tier, path) = 1) USING (doc_id)"""
SQL["completeness"] = """WITH r AS (SELECT d.doc_id, CASE WHEN d.doc_id % 10 = 0 THEN '' ELSE source END AS source, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))
SELECT count(*) AS n, count(*) FILTER (source <> '' AND quality IS NOT NULL AND toxic IS NOT NULL) AS complete, count(*) FILTER (source <> '') AS has_source, count(quality) AS has_quality, count(toxic) AS has_toxic FROM r"""
SQL["first_turns"] = "SELECT conv_id, role, turn, md5(text) AS text_md5 FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) = 1"
SQL["first_last_turn"] = "SELECT conv_id, first(role ORDER BY turn, role) AS first_role, last(role ORDER BY turn, role) AS last_role, count(*) AS n FROM conversations GROUP BY 1"
SQL["text_search"] = "SELECT doc_id, CASE WHEN length(text) > 50 THEN 51 ELSE length(text) END AS n, upper(left(lang, 1)) || lower(substr(lang, 2)) AS lang FROM documents WHERE contains(lower(source), 'src1') OR contains(lower(lang), 'src1')"
SQL["yearly_values"] = "SELECT (1929 + user_id % 3)::VARCHAR AS slice, count(*) AS n, round(avg(floor(value)), 2) AS mean, min(floor(value)) AS min, max(floor(value)) AS max FROM events GROUP BY 1"

SQL["word_forms"] = f"""WITH {SPACED}, f AS (SELECT token AS form, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM raw WHERE starts_with(replace(lower(regexp_replace(token, '[.,!?]+$', '')), 'ſ', 's'), 'ver') GROUP BY 1)
SELECT row_number() OVER (ORDER BY n DESC, form) AS rank, form, n, n_docs FROM f QUALIFY rank <= 20"""
SQL["explore_terms"] = f"WITH {TOKENS}, n AS (SELECT count(*) AS t FROM tok) SELECT token, count(*) AS abs, {ppm('count(*)', 'any_value(t)')} AS per_million FROM tok, n WHERE contains(token, 'ver') GROUP BY token ORDER BY abs DESC, token LIMIT 25"
SQL["explore_seeds"] = f"WITH {GRID} SELECT term, {PIVOT} FROM grid GROUP BY 1 ORDER BY sum(abs) DESC, term LIMIT 3"
SQL["explore_keywords"] = f"WITH {KEYNESS} SELECT token, g2, pm_diff FROM key WHERE transition = '1929→1930' AND direction = 'Aufsteiger' ORDER BY abs(g2) DESC, token LIMIT 15"
SQL["explore_keyword_seeds"] = f"""WITH {KEYNESS}, {SEEDS} SELECT token, avg(g2) FILTER (transition = '1929→1930') AS t0, avg(g2) FILTER (transition = '1930→1931') AS t1 FROM key WHERE token IN (SELECT term FROM seeds) GROUP BY 1"""
SQL["explore_ngrams"] = f"WITH {NGRAMS} SELECT * FROM ng WHERE n = 2 AND scope = '1930' ORDER BY abs DESC, ngram LIMIT 12"
SQL["explore_collocates"] = f"WITH {COLLOC} SELECT collocate, cofreq, pmi FROM col WHERE target = 'the' AND scope = '1929' ORDER BY pmi DESC, collocate LIMIT 12"
SQL["explore_topic_labels"] = f"WITH {TOKENS}, {topic_terms(5, 'a')} SELECT topic, terms[1] || ', ' || terms[2] || ', ' || terms[3] AS label FROM a"
SQL["explore_share_map"] = f"WITH x AS ({SQL['topic_shares']}) SELECT topic, any_value(mean_share) FILTER (slice = 1929) AS y1929, any_value(mean_share) FILTER (slice = 1930) AS y1930, any_value(mean_share) FILTER (slice = 1931) AS y1931 FROM x GROUP BY 1"

SQL["freq_first_seen"] = f"""WITH {TOKENS}, c AS (SELECT token, count(*) AS abs, min(struct_pack(d := doc_id, p := pos)) AS f FROM tok GROUP BY 1)
SELECT row_number() OVER (ORDER BY abs DESC, f) AS rank, token, abs FROM c QUALIFY rank <= 200"""
SQL["overview_report"] = f"""WITH {OVERVIEW} SELECT slice AS Jahrgang, format('{{:,}}', n_tokens) AS Tokens, format('{{:,}}', n_types) AS Typen, printf('%.1f', n_tokens / n_docs) AS "je Dokument" FROM sizes JOIN types USING (slice)"""

SQL["pattern_citations"] = r"""WITH p(pattern, r) AS (VALUES ('thing', '(?i)thing[a-z]*'), ('ver', '(?i) ver[a-z]*')), m AS (SELECT doc_id, (1929 + doc_id % 3)::INT AS slice, pattern, text, regexp_extract_all(text, r) AS m, regexp_split_to_array(text, r) AS b FROM documents, p),
h AS (SELECT doc_id, slice, pattern, text, unnest(m) AS match, unnest(list_slice(b, 1, len(m))) AS b, generate_subscripts(m, 1) AS i FROM m),
e AS (SELECT *, sum(length(b) + length(match)) OVER (PARTITION BY doc_id, pattern ORDER BY i) AS e FROM h),
w AS (SELECT doc_id, slice, pattern, (e - length(match))::INT AS start, e::INT AS "end", match, list_filter(regexp_split_to_array(left(text, (e - length(match))::BIGINT), '\s+'), lambda x: x <> '') AS l, list_filter(regexp_split_to_array(substr(text, (e + 1)::BIGINT), '\s+'), lambda x: x <> '') AS r FROM e)
SELECT doc_id, slice, pattern, start, "end", match, trim(array_to_string(list_slice(l, greatest(len(l) - 14, 1), len(l)), ' ') || ' [TREFFER] ' || match || ' [/TREFFER] ' || array_to_string(list_slice(r, 1, 15), ' ')) AS context FROM w"""

SQL["report_seeds"] = f"WITH {GRID} SELECT slice, row_number() OVER (PARTITION BY slice ORDER BY per_million DESC, term) AS rank, term, category, abs, round(per_million, 1) AS per_million FROM grid QUALIFY rank <= 3"
SQL["report_quotations"] = f"""WITH {KWIC}, c AS (SELECT slice, doc_id, pos_in_doc, target, doc_id || ': ' || (CASE WHEN pos_in_doc = 0 THEN '' ELSE "left" END) || '  [' || keyword || ']  ' || "right" AS q FROM k)
SELECT slice, row_number() OVER (PARTITION BY slice ORDER BY doc_id, pos_in_doc, target) AS rank, CASE WHEN length(q) > 150 THEN left(q, 150) || '…' ELSE q END AS quotation FROM c QUALIFY rank <= 3"""
SQL["csv_nations"] = "SELECT n_nationkey, n_name FROM nation"
SQL["parquet_slices"] = f"SELECT doc_id, {SLICE} AS slice, lang FROM documents"
SQL["text_tree"] = "SELECT n_name AS name, (1925 + n_regionkey)::VARCHAR AS folder, 'Über ' || n_name || '|end' AS text FROM nation"
SQL["lexicon_file"] = """WITH w AS (SELECT unnest([lower(p_brand), lower(p_brand) || 's', 'x' || p_partkey % 5]) AS word, round(-(p_partkey % 7) / 4, 2) + 0.0 AS weight FROM part) SELECT word, min(weight) AS weight FROM w GROUP BY 1"""
SQL["word_file"] = "SELECT DISTINCT lower(n_name) AS token FROM nation"
SQL["topic_files"] = """SELECT 'doc' || n_nationkey AS doc_id, CASE WHEN n_regionkey < 4 THEN n_regionkey ELSE 0 END::INT AS topic, CASE WHEN n_regionkey = 0 THEN 0.6 ELSE 0.1 END AS topic_0, 0.0 AS topic_4,
round(((CASE WHEN n_regionkey < 4 THEN n_regionkey ELSE 0 END) + 1) / 10, 2) AS weight, 'alpha ' || lower(r_name) AS terms FROM nation JOIN region ON r_regionkey = CASE WHEN n_regionkey < 4 THEN n_regionkey ELSE 0 END"""
SQL["joined_pages"] = "SELECT conv_id AS doc_id, max(turn) AS n_pages, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn, text)) AS text_md5 FROM conversations GROUP BY 1"
SQL["paired_names"] = """WITH r AS (SELECT lower(r_name) AS name, r_regionkey FROM region UNION ALL SELECT lower(n_name), NULL FROM nation WHERE n_nationkey < 9) SELECT lower(n_name) AS name, n_regionkey, r_regionkey FROM nation JOIN r ON r.name = lower(n_name)"""
