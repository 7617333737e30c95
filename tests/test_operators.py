"""Operators on micro corpora: edges of documents, overlaps, empty and null values, ties."""

import re

import pytest
from pyspark.sql import functions as F

from textloom.operators import collocations, correction, density, frequency, keyness, kwic, metadata, ngrams, report, sections, topics, windows
from textloom.operators.corpus import corpus, decoded_tokens, encoded_tokens, overview, token_rows, with_slice, year_from_name

MICRO = [(1, 1929, "Über Müßige, über ÜBER."), (2, 1929, "a b a b a"), (3, 1930, "a"), (4, 1930, ""), (5, 1931, "Eins ist da. zwei folgt. Drei kam! Vier"), (6, None, "a c"), (7, 1931, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(MICRO, "doc_id long, slice int, text string")


@pytest.fixture(scope="module")
def tokens(docs):
    return corpus(docs)


def table(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_null_slice_counts_in_total_only(tokens):
    found = frequency.scoped_frequencies(tokens).where("token = 'a'")
    assert table(found, "scope", "abs") == {("gesamt", 5), ("1929", 3), ("1930", 1)}
    total = sum(r["n_tokens"] for r in tokens.collect())
    by_slice = sum(r["total"] for r in frequency.totals(tokens.where("slice is not null"), "slice").collect())
    assert total - by_slice == 2


def test_slice_policies(spark):
    df = spark.createDataFrame([("1930 a",), ("x",)], "name string")
    year = year_from_name("name")
    kept = lambda policy, fallback=None: [r[0] for r in with_slice(df, year, policy, fallback).select("slice").collect()]
    assert kept("keep_null") == [1930, None]
    assert kept("default", 1929) == [1930, 1929]
    assert kept("label", "unbekannt") == ["1930", "unbekannt"]
    assert kept("drop") == [1930]


def test_tokens_keep_order_and_survive_the_codec(spark, tokens):
    assert [r["token"] for r in token_rows(tokens).where("doc_id = 2").orderBy("pos").collect()] == list("ababa")
    back = tokens.select(decoded_tokens(encoded_tokens("tokens")).alias("t"), "tokens")
    assert all(r["t"] == r["tokens"] for r in back.collect())


def test_lemmas_replace_forms_in_place(spark, docs):
    lemmas = spark.createDataFrame([("b", "x")], "form string, lemma string")
    found = {r["doc_id"]: r["tokens"] for r in corpus(docs, lemmas=lemmas).collect()}
    assert found[2] == ["a", "x", "a", "x", "a"] and found[4] == []


def test_overview_has_empty_documents(tokens):
    rows = {r["slice"]: r for r in overview(tokens).collect()}
    assert rows[1930]["n_docs"] == 2 and rows[1930]["n_tokens"] == 1 and rows[None]["n_types"] == 2


def test_ngrams_of_short_documents(tokens):
    found = ngrams.ngram_counts(tokens).where("scope = 'gesamt'")
    assert ("a b", 2, 2) in table(found, "ngram", "n", "abs") and ("a b a", 3, 2) in table(found, "ngram", "n", "abs")
    assert table(ngrams.ngram_counts(tokens).where("scope = '1930'"), "ngram") == set()


def test_overlapping_windows_count_each_time(tokens):
    rows = collocations.window_rows(tokens.where("doc_id = 2"), ["a"], 2)
    assert rows.where("collocate = 'b'").count() == 4 and rows.where("collocate = 'a'").count() == 0


def test_cofrequency_is_symmetric(tokens):
    rows = collocations.window_rows(tokens.where("doc_id = 2"), ["a", "b"], 1)
    n = {tuple(r): 0 for r in rows.select("target", "collocate").distinct().collect()}
    for r in rows.collect():
        n[r["target"], r["collocate"]] += 1
    assert n["a", "b"] == n["b", "a"]


def test_kwic_at_the_edges(docs):
    hits = kwic.kwic(docs.where("doc_id = 2"), [("a", "^a$")], 1)
    assert table(hits, "left", "right", "pos_in_doc") == {("", "b", 0), ("b", "b", 2), ("b", "", 4)}
    assert table(hits.where("pos_in_doc = 2"), "concordance") == {("b  [a]  b",)}


def test_citations_hold_offsets(docs):
    found = kwic.citations(docs, [("über", "über")], 1).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["end"]) for r in found] == [(1, 0, 4), (1, 13, 17), (1, 18, 22)]
    assert found[1]["context"] == "Müßige, [TREFFER] über [/TREFFER] ÜBER."


def test_anchor_windows_strip_punctuation(docs):
    found = windows.anchor_windows(docs.where("doc_id = 1"), "(?iU)über", 1)
    assert found.count() == 3 and "Müßige, über ÜBER." in {r["context"] for r in found.collect()}


def test_keyness_swaps_sign(tokens):
    a = {r["token"]: r["g2"] for r in keyness.keyness(tokens, [(1929, 1930)], 1).collect()}
    b = {r["token"]: r["g2"] for r in keyness.keyness(tokens, [(1930, 1929)], 1).collect()}
    assert a.keys() == b.keys() and all(a[t] == -b[t] for t in a)


def test_sections_swallow_a_second_start(spark):
    text = "before\nSTART\nx\nSTART\ny\nEND\nz\nSTART\nw"
    lines = sections.text_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert [r["line"] for r in sections.section_lines(lines, "^START", "^END").orderBy("pos").collect()] == ["x", "y", "w"]


def test_bullet_grammars(spark):
    df = spark.createDataFrame([("W. Becker, Weg 9: Text",), ("Möbel: J. Moll, Lohn 62; Bodden, Berg 4",), ("Nur ein Name",)], "e string")
    assert [r[0] for r in df.select(sections.bullet_names(F.col("e"))).collect()] == [["W. Becker"], ["J. Moll", "Bodden"], ["Nur ein Name"]]


def test_names_are_cleaned_or_rejected(spark):
    df = spark.createDataFrame([("  • Becker & Co. ",), ("12345",), ("ab",), ("klein",), (None,)], "n string")
    assert [r[0] for r in df.select(sections.clean_name(F.col("n"))).collect()] == ["Becker & Co", None, None, None, None]


def test_line_groups_are_anchored_at_their_first_character(spark):
    chars = [("f", 1, c, 20.0, "Bold", top, float(i)) for i, (c, top) in enumerate([("a", 10.0), ("b", 11.5), ("c", 12.4), ("d", 13.0)])]
    lines = sections.char_lines(spark.createDataFrame(chars, "file string, page int, text string, size double, fontname string, top double, x0 double"))
    assert table(lines, "line_no", "text") == {(0, "ab"), (1, "cd")}


def test_rules_apply_in_order(spark):
    rules = [("ae", "Ae", "Ä"), ("ue", "Ue", "Ü"), ("dass", "dass", "daß"), ("oe", "Oe", "Ö"), ("same", "Ä", "Ä"), ("gone", "Aerger", "x")]
    row = correction.corrected(spark.createDataFrame([(8, "Aerger Ueber dass Oeffentlich")], "doc_id long, text string"), rules).first()
    assert row["text"] == "Ärger Über daß Öffentlich" and [row[f"n_{k}"] for k in range(6)] == [1, 1, 1, 1, 1, 0]


def test_error_rates_have_a_mean_row(spark):
    pairs = spark.createDataFrame([("a", "daß es", "dass es"), ("b", "Tag", "Tag")], "name string, reference string, text string")
    rows = {r["name"]: r for r in correction.error_rates(pairs, [("ss", "dass", "daß")]).collect()}
    assert rows["a"]["cer_before"] == 33.33 and rows["a"]["cer_after"] == 0.0 and rows["DURCHSCHNITT (2)"]["cer_before"] == 16.67


def test_dates(spark):
    texts = ["Sonnabend, den 3. Mai 1930", "am 31. Februar 1930 und 1. März 1930", "30.4.1931", "5. Juni 1999 Mittwoch", "ohne"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    day = metadata.date_in_text(F.col("t"), F.lit(1930))
    found = df.select(F.date_format(day, "yyyy-MM-dd"), metadata.weekday_name(day, F.col("t")), metadata.long_date(day)).collect()
    assert found[0] == ("1930-05-03", "Samstag", "3. Mai 1930") and found[2][0] == "1931-04-30"
    assert found[1][0] is None and found[3][:2] == (None, "Mittwoch") and found[4][0] is None and found[4][1] is None


def test_tiers_fall_back_in_order(spark):
    docs = spark.createDataFrame([("12. Ausgabe 1930", 1930), ("gleich", 1931), ("gleich-2", 1929), ("ein langer Name a", 1930), ("nichts", 1930)], "doc_id string, year int")
    files = spark.createDataFrame([("/1930/a", 1930, "12. Ausgabe 1930"), ("/b", None, "gleich"), ("/c2", 1930, "ein langer Name c"), ("/c1", 1930, "ein langer Name b")], "path string, year int, stem string")
    assert table(metadata.tiered_join(docs, files), "doc_id", "path", "tier") == {("12. Ausgabe 1930", "/1930/a", 1), ("gleich", "/b", 2), ("gleich-2", "/b", 3), ("ein langer Name a", "/c1", 4), ("nichts", None, None)}


def test_issue_table(spark):
    docs = spark.createDataFrame([("x", "12. Ausgabe 1930", "Bote vom 3. Mai 1930"), ("y", "ohne", "nichts")], "doc_id string, name string, text string")
    tokens = corpus(docs.withColumn("slice", F.lit(1930)))
    pages = spark.createDataFrame([("x", 1), ("x", 8)], "doc_id string, page int")
    quality = spark.createDataFrame([(1930, 12, 7.5, 20.0)], "year int, issue int, cer double, wer double")
    rows = metadata.issue_table(docs, tokens, pages, quality).collect()
    assert [(r["issue"], r["year"], r["date_iso"], r["n_pages"], r["cer"]) for r in rows] == [(12, 1930, "1930-05-03", 8, 7.5), (None, None, None, None, None)]


def test_scores_weigh_bullets_double(spark):
    bullets = spark.createDataFrame([(i, i, "A") for i in range(11)], "doc_id long, pos int, name string")
    seen = spark.createDataFrame([(i, i, "A", "ORG") for i in range(6)], "doc_id long, pos int, name string, kind string")
    row = sections.name_scores(bullets, seen).first()
    assert (row["score"], row["kind"], row["rank"]) == (28, "ORG", 1)


def test_density_leaves_out_empty_documents(spark, docs):
    found = density.lexicon_density(docs, spark.createDataFrame([("eins",)], "word string"), r"[a-zäöüß]{3,}")
    assert table(found, "doc_id", "density") == {(1, 0.0), (5, 142.86)}


def test_nmf_loss_never_rises(spark):
    rows = [(d, f"t{t}", float((d % 3 == t % 3) + 0.1)) for d in range(12) for t in range(9)]
    weights = spark.createDataFrame(rows, "doc_id long, term string, weight double")
    found = topics.nmf(weights, k=3, rounds=12, tolerance=0)
    assert all(b <= a + 1e-6 for a, b in zip(found.losses, found.losses[1:])) and found.losses[-1] < found.losses[0] / 2
    again = topics.nmf(weights, k=3, rounds=12, tolerance=0)
    assert found.losses == pytest.approx(again.losses)
    shares = topics.with_dominant(topics.normalised_shares(found.shares, 3), 3).collect()
    assert all(sum(r[f"topic_{t}"] for t in range(3)) == pytest.approx(1) for r in shares) and len({r["dominant_topic"] for r in shares}) == 3


def test_lda_shapes(spark):
    docs = spark.createDataFrame([(d, 1929, " ".join(["x", "y", "z", "w"][d % 2 :: 2] * 5)) for d in range(20)], "doc_id long, slice int, text string")
    terms, shares = topics.lda(corpus(docs), k=2, rounds=5, min_df=1, max_df=1.0, n_terms=2)
    assert terms.count() == 4
    assert all(r["topic_0"] + r["topic_1"] == pytest.approx(1) for r in shares.collect())


def test_report_is_markdown(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "term string, abs long")
    text = report.report({"Terms": df})
    assert "## Terms" in text and "| term | abs |" in text and "|---|---:|" in text and "|  | 2 |" in text


def test_stages_make_what_they_need(docs):
    from textloom.plans.stages import Run, Settings

    run = Run(docs, Settings(min_length=1, slices=[1929, 1930, 1931], targets=["a"], kwic_targets=[("a", "^a$")]))
    assert run.table("keyness").columns[0] == "transition" and "corpus" in run.tables
    assert run.table("kwic").count() == 5 and "## Overview" in run.report(["overview"])
    with pytest.raises(KeyError):
        run.table("nothing")


def test_consolidated_report(docs):
    from textloom.plans.stages import STAGES, Run, Settings

    rich = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 100)).unionByName(docs.withColumn("doc_id", F.col("doc_id") + 200))
    settings = Settings(
        min_length=1, slices=[1929, 1930, 1931], targets=["a"], kwic_targets=[("a", "^a$")], seeds={"a": "x", "über": "y"}, stems=[("a", "x")], lexicon=[("eins", -1.0)],
        rules=[("b", "b", "c")], vocabulary=["a", "ist"], n_topics=2, topic_rounds=3,
    )
    run = Run(rich, settings)
    text = run.report()
    for title in ("Corpus", "Seed terms", "Keywords", "n-grams with seed terms", "n-grams by category", "Collocates", "Topics", "Topics by slice", "Concordances", "Quotations", "Text quality", "Lexicon density", "Summary"):
        assert f"## {title}\n" in text
    assert all(run.table(s).columns for s in STAGES)
    held = run.table("corpus")
    assert held.storageLevel.useDisk and run.table("corpus") is held
    run.close()
    assert not run.tables


def test_token_rates_with_very_many_tokens(spark):
    from textloom.functions.text import token_edit_rate

    words = [f"w{i}" for i in range(40_000)]
    other = words[:-1] + ["other"]
    df = spark.createDataFrame([(" ".join(words), " ".join(other)), (" ".join(words[:10]), " ".join(words[30:40]))], "a string, b string")
    assert [r[0] for r in df.select(token_edit_rate(F.col("a"), F.col("b"), 4)).collect()] == [0.0025, 100.0]


def test_edit_rates_equal_brute_force(spark):
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, d in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (c != d))
        return row[-1]

    rng = random.Random(2)
    rows = []
    for n in range(12):
        a = "".join(rng.choice("aeß th.19l ") for _ in range(rng.randint(0, 300)))
        rows.append((str(n), a, a.replace("th", "t")[: rng.randint(1, 300)]))
    rules = [("ae", "ae", "ä"), ("one", "([0-9])l", "$1")]
    found = {r["name"]: r for r in correction.error_rates(spark.createDataFrame(rows, "name string, reference string, text string"), rules).collect()}
    for name, a, b in rows:
        after = re.sub("([0-9])l", r"\1", b.replace("ae", "ä"))
        for column, other in (("before", b), ("after", after)):
            assert found[name][f"cer_{column}"] == pytest.approx(100 * distance(a, other) / max(1, len(a)), abs=0.0051)
            x, y = a.lower().split(), other.lower().split()
            assert found[name][f"wer_{column}"] == pytest.approx(100 * distance(x, y) / max(1, len(x)), abs=0.0051)


def test_citations_find_words_beside_matches(spark):
    text = "one two abc3 four-abcd five  six abc"
    df = spark.createDataFrame([(1, 1930, text)], "doc_id long, slice int, text string")
    found = kwic.citations(df, [("abc", "abc")], 2).orderBy("start").collect()
    assert [(r["start"], r["context"]) for r in found] == [(8, "one two [TREFFER] abc [/TREFFER] 3 four-abcd"), (18, "abc3 four- [TREFFER] abc [/TREFFER] d five"), (33, "five six [TREFFER] abc [/TREFFER]")]


def test_plugins_load_a_model_and_may_skip(docs):
    from textloom.operators import plugins

    def scored(model, text):
        if not text:
            raise ValueError("nothing to score")
        return float(len(text) * model)

    found = plugins.annotated(docs, lambda: 2, scored, "double", "score", on_error="skip")
    assert table(found.where("doc_id in (3, 4, 7)"), "doc_id", "score") == {(3, 2.0), (7, None)}
    tagged = plugins.tagged(docs, lambda: None, lambda _, t: [{"text": w, "lemma": w.strip("."), "pos": None, "is_stop": w == "da."} for w in t.split()])
    rows = {r["doc_id"]: r for r in plugins.lemma_corpus(tagged.where("text is not null") if "text" in tagged.columns else tagged, 3).collect()}
    assert rows[5]["tokens"] == ["eins", "ist", "zwei", "folgt", "drei", "vier"] and rows[5]["n_raw_tokens"] == 8


def test_phrase_scores_in_small_units(spark, monkeypatch):
    import math
    import random
    from collections import Counter

    from textloom.operators import tfidf

    monkeypatch.setattr(tfidf, "UNIT_BYTES", 300)
    monkeypatch.setattr(tfidf, "WINDOWS_AT_ONCE", 3)
    rng = random.Random(5)
    made = [(i, 1929 + i % 2 if i % 9 else None, " ".join(rng.choice(["der", "und", "The,", "an-den", "auf", "Haus", "weg", "--", "x"]) for _ in range(rng.randrange(40)))) for i in range(40)] + [(50, 1929, None), (51, 1929, "der der")]
    df = spark.createDataFrame(made, "doc_id long, slice int, text string")
    query = tfidf.phrase_scores(df, r"(?iU)the|der", 4, ("und",), k=50)
    held = []
    for _, part, text in made:
        parts = (text or "").split()
        for i, t in enumerate(parts):
            if part and t.strip(",").lower() in ("the", "der"):
                w = [x for x in re.findall(r"\w+", " ".join(parts[max(0, i - 4) : i + 5]).lower()) if x != "und"]
                held.append((part, Counter([" ".join(w[j : j + n]) for n in (2, 3) for j in range(len(w) - n + 1)])))
    df_, sums, n = Counter(t for _, c in held for t in c), Counter(), Counter(p for p, _ in held)
    for part, c in held:
        w = {t: (1 + math.log(k)) * (math.log((1 + len(held)) / (1 + df_[t])) + 1) for t, k in c.items() if 3 <= df_[t] <= 0.85 * len(held)}
        norm = math.sqrt(sum(x * x for x in w.values()))
        for t, x in w.items():
            sums[part, t] += x / norm
    expected = {}
    for part in n:
        ranked = sorted((-round(s / n[part], 5), t) for (p, t), s in sums.items() if p == part)[:50]
        expected |= {(part, r + 1): (t, -s) for r, (s, t) in enumerate(ranked)}
    assert {(r["slice"], r["rank"]): (r["term"], r["score"]) for r in query.collect()} == expected and len(expected) > 50


def test_ngrams_in_small_parts(spark, monkeypatch):
    import random
    from collections import Counter

    monkeypatch.setattr(ngrams, "TOKENS_AT_ONCE", 7)
    rng = random.Random(4)
    made = [(i, rng.choice([1929, 1930, None]), [rng.choice("abcde") for _ in range(rng.randrange(12))] if i != 5 else None) for i in range(60)]
    df = spark.createDataFrame(made, "doc_id long, slice int, tokens array<string>").withColumn("n_tokens", F.coalesce(F.size("tokens"), F.lit(0)))
    for seeds in (None, ["a", "c"]):
        expected = Counter()
        for _, part, t in made:
            for n in (1, 2, 3):
                for j in range(len(t or []) - n + 1):
                    if seeds is None or set(t[j : j + n]) & set(seeds):
                        for scope in {"gesamt", str(part)} - {"None"}:
                            expected[scope, n, " ".join(t[j : j + n])] += 1
        counts = ngrams.ngram_counts(df, (1, 2, 3), seeds=seeds)
        assert {(r["scope"], r["n"], r["ngram"]): r["abs"] for r in counts.collect()} == expected
        top = ngrams.top_ngrams(counts, 4).collect()
        for scope, n in {(s, n) for s, n, _ in expected}:
            best = sorted(((-c, g) for (s, m, g), c in expected.items() if (s, m) == (scope, n)))[:4]
            assert sorted((r["rank"], -r["abs"], r["ngram"]) for r in top if (r["scope"], r["n"]) == (scope, n)) == [(k + 1, *x) for k, x in enumerate(best)]


def test_nmf_equals_dense_updates_in_small_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(topics, "BLOCK", 4)
    rng = np.random.default_rng(3)
    x = np.where(rng.random((12, 6)) < 0.6, rng.random((12, 6)), 0)
    x[:, 0] += 0.1
    rows = [(i, f"t{j}", float(x[i, j])) for i in range(12) for j in range(6) if x[i, j]]
    found = topics.nmf(spark.createDataFrame(rows, "doc_id long, term string, weight double"), k=2, rounds=5, tolerance=-1.0)
    h, losses = np.random.default_rng(42).random((2, 6)) + 0.1, []
    for _ in range(5):
        w = np.full((12, 2), 0.5)
        for _ in range(20):
            w *= (x @ h.T) / (w @ (h @ h.T) + topics.EPSILON)
        losses.append(((x - w @ h) ** 2).sum())
        top, gram = w.T @ x, w.T @ w
        for _ in range(5):
            h = h * top / (gram @ h + topics.EPSILON)
    assert found.losses == pytest.approx(losses) and np.allclose(found.components, h)
    assert found.shares.count() == 12


def test_tfidf_deals_once_by_key(spark):
    from textloom.operators import tfidf

    df = spark.createDataFrame([(i, ["a", "b", "b", f"c{i % 2}"]) for i in range(8)] + [(0, ["a"])], "doc_id long, tokens array<string>")
    made = tfidf.weights(df, "doc_id", "tokens", min_df=1, max_df=2.0)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(doc_id#\d+L, term|Exchange hashpartitioning\(doc_id#\d+L,? ?\d*\), ENSURE", plan)) == 0
    assert made.where("doc_id = 0").count() == 3


def test_lda_takes_words_in_a_total_order(spark):
    rows = [(i, 1929, ["b", "a", "often", "often", f"w{i % 2}"][: 4 + i % 3], 4) for i in range(12)] + [(20, 1929, ["rare"] * 9, 9)]
    df = spark.createDataFrame(rows, "doc_id long, slice int, tokens array<string>, n_tokens int")
    kept = set(spark.sparkContext._jsc.getPersistentRDDs())
    terms, shares = topics.lda(df, k=2, rounds=2, vocabulary=3, min_df=2, max_df=0.95, n_terms=3)
    assert {r["term"] for r in terms.collect()} == {"often", "a", "b"} and shares.count() == 13
    assert {r["term"] for r in topics.lda(df, k=2, rounds=2, vocabulary=3, min_df=2, max_df=0.5, n_terms=3)[0].collect()} == {"w0", "w1"}
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= kept


def test_lemmas_from_a_dictionary_or_a_join(spark, docs, monkeypatch):
    from textloom.operators import corpus as module

    lemmas = spark.createDataFrame([("b", "x"), ("B", "Y"), ("ist", "sein"), ("da", None), (None, "z")], "form string, lemma string")
    made = lambda: {r["doc_id"]: (r["tokens"], r["n_tokens"]) for r in corpus(docs.unionByName(docs.where("doc_id = 2").withColumn("doc_id", F.lit(9))), lemmas=lemmas).collect()}
    assert "Exchange" not in corpus(docs, lemmas=lemmas)._jdf.queryExecution().executedPlan().toString()
    few = made()
    monkeypatch.setattr(module, "MOST_ROWS", 1)
    assert made() == few and few[2] == few[9] == (["a", "x", "a", "x", "a"], 5) and few[4] == few[7] == ([], 0)
    assert few[5][0] == ["eins", "sein", "da", "zwei", "folgt", "drei", "kam", "vier"]


def test_pages_in_one_row_and_as_character_rows(spark):
    import random

    rng = random.Random(6)
    chars = [("f", p, c, rng.choice([9.0, 20.0]), rng.choice(["Serif-Bold", "Serif"]), rng.randrange(60) / 4, float(i)) for p in range(3) for i, c in enumerate("Ein langer Titel, und mehr davon")]
    df = spark.createDataFrame(chars, "file string, page int, text string, size double, fontname string, top double, x0 double")
    expected = set()
    for p in range(3):
        lines, anchor = [], None
        for c in sorted((c for c in chars if c[1] == p), key=lambda c: (c[5], c[6])):
            if anchor is None or abs(c[5] - anchor) > 2:
                anchor = c[5]
                lines.append([])
            lines[-1].append(c)
        expected |= {("f", p, n, "".join(c[2] for c in sorted(x, key=lambda c: c[6])).strip(" "), max(c[3] for c in x), any(c[4] == "Serif-Bold" for c in x)) for n, x in enumerate(lines)}
    pages = df.groupBy("file", "page").agg(F.collect_list(sections.char_item()).alias("c"))
    for made in (sections.char_lines(df), sections.page_lines(pages)):
        assert table(made, "file", "page", "line_no", "text", "size", "bold") == expected
    assert sections.page_lines(pages)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_tagged_collocates_count_every_window(spark):
    import random
    from collections import Counter

    rng = random.Random(8)
    made = [(i, [(w, w, rng.choice(["NOUN", None, "DET"]), w == "und") for w in rng.choices(["verb", "verſ", "haus", "weg", "und", "Tür"], k=rng.randrange(30))] if i else None) for i in range(20)]
    df = spark.createDataFrame(made, "doc_id long, tokens array<struct<text: string, lemma: string, pos: string, is_stop: boolean>>")
    n, last = Counter(), {}
    for _, tokens in made:
        for i, t in enumerate(tokens or []):
            if t[0].startswith("ver"):
                for j in range(max(0, i - 3), min(len(tokens), i + 4)):
                    w, p = tokens[j][0].lower(), tokens[j][2]
                    if j != i and p != "DET" and w != "und" and not w.startswith("ver"):
                        n[w] += 1
        last |= {t[0].lower(): t[2] for i, t in enumerate(tokens or []) if t[2] != "DET" and any(tokens[j][0].startswith("ver") for j in range(max(0, i - 3), min(len(tokens), i + 4)) if j != i)}
    found = collocations.tagged_collocations(df, "ver", window=3, k=9)
    assert "Generate explode" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["collocate"], r["n"]) for r in found.orderBy("rank").collect()] == sorted(n.items(), key=lambda x: (-x[1], x[0]))
    assert {r["collocate"]: r["pos_tag"] for r in found.collect()} == {w: last[w] for w in n}


def test_citations_leave_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(kwic, "CITATIONS_AT_ONCE", 3)
    df = spark.createDataFrame([(1, 1929, "a thing " * 10), (2, None, None), (3, 1930, "no"), (4, None, "Things")], "doc_id long, slice int, text string")
    rows = kwic.citations(df, [("t", "thing[a-z]*")], 2).collect()
    assert [(r["doc_id"], r["slice"], r["match"]) for r in rows] == [(1, 1929, "thing")] * 10 + [(4, None, "Things")]
    assert rows[0]["context"] == "a [TREFFER] thing [/TREFFER] a thing" and rows[9]["context"] == "thing a [TREFFER] thing [/TREFFER]"
