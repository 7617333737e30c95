"""Toxicity and quality: held-out accuracy, folding, edges."""

import numpy as np
import pytest

from textloom.llm import quality, toxicity
from textloom.llm.labels import fold_of


def accuracy(found, labels, column, held_out=True):
    want = {r["doc_id"]: r[column] for r in labels.collect()}
    rows = [r for r in found.collect() if r["held_out"] == held_out]
    assert rows
    return np.mean([r["predicted"] == want[r["doc_id"]] for r in rows])


def test_toxicity_holds_out(labelled):
    docs, labels = labelled
    assert accuracy(toxicity.score_documents(docs, labels), labels, "toxic") >= 0.95


def test_quality_holds_out(labelled):
    docs, labels = labelled
    assert accuracy(quality.score_documents(docs, labels), labels, "quality") >= 0.95


def test_folding():
    assert toxicity.fold("1d10t Mоrоn stúpid l0ser $cum pаthetic") == "idiot moron stupid loser scum pathetic"
    assert toxicity.fold("in 2010 a1 99") == "in 2010 a1 99"
    assert toxicity.fold("c10wn 5tup1d", toxicity.DIGITS_L) == "clown stupld" and toxicity.fold("c10wn 5tup1d") == "ciown stupid"
    assert toxicity.fold("mo​ron") == "moron"


def test_exceptions_and_word_beginnings():
    found = toxicity._automaton(dict.fromkeys(toxicity.SEEDS, 4.0), toxicity.EXCEPTIONS)
    hits = lambda t: [toxicity.fold(t)[s:e] for s, e, _ in toxicity.spans(toxicity.fold(t), found)]
    assert hits("what an IDIOT") == ["idiot"] and hits("a trash can here") == [] and hits("trash cans and trash") == ["trash", "trash"]
    assert hits("untrash") == [] and hits("clown fish, clown") == ["clown"]


def test_length_normalises():
    found = toxicity._automaton({"scum": 4.0}, ())
    assert toxicity.density("scum a b", found) > toxicity.density("scum " + "a " * 200, found) > 0 == toxicity.density("", found)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_awkward_rows_all_get_a_score(module, awkward, awkward_rows, labelled, nothing):
    found = module.score_documents(awkward, labelled[1]).collect()
    assert len(found) == len(awkward_rows) and all(0 <= r["score"] <= 1 for r in found)
    assert all(r["held_out"] for r in found if r["doc_id"] is None)
    assert module.score_documents(nothing, labelled[1]).count() == 0


@pytest.mark.parametrize("module", [toxicity, quality])
def test_no_labels(module, labelled):
    docs, labels = labelled
    found = module.score_documents(docs, labels.limit(0)).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)


def test_held_out_labels_change_nothing(labelled):
    from pyspark.sql import functions as F

    docs, labels = labelled
    other = labels.withColumn("toxic", F.when(fold_of(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, other)
    assert a.weights == b.weights and (a.slope, a.offset) == (b.slope, b.offset)


def test_threshold_is_a_quantile():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, len(quality.FEATURES)))
    y = (x[:, 3] - x[:, 7] > -1).astype(int)
    model = quality.fit_pairs(x, y, pairs=5000, rounds=200)
    score = model.score(x)
    assert ((score >= 0.7) == (y == 1)).mean() > 0.93
    assert (score < 0.7).mean() == pytest.approx(model.quantile, abs=0.01)


def test_features_are_defined_everywhere():
    for text in ("", " ", "\n", "a", "!!", "🙂 " * 5, "A" * 100_000):
        f = quality.features(text)
        assert len(f) == len(quality.FEATURES) and np.isfinite(f).all()


def test_ones_may_be_either_letter():
    found = toxicity._automaton(dict.fromkeys(toxicity.SEEDS, 4.0), ())
    assert toxicity.density("c10wn 5tup1d", found) == pytest.approx(toxicity.density("clown stupid", found))
    assert toxicity.density("clown stupid", found) > 0


def test_quality_learns_from_every_label(spark):
    """20,000 documents, of which those far back in the order of the hash of ids are few and alone show what a bar means."""
    from pyspark.sql import functions as F

    base = spark.range(20_000).select(F.col("id").alias("doc_id")).withColumn("late", F.expr("row_number() over (order by xxhash64(doc_id), doc_id) > 19000"))
    docs = base.select("doc_id", F.when(F.col("late") & (F.col("doc_id") % 2 == 0), F.lit("some plain words | and a bar")).when(F.col("doc_id") % 2 == 0, F.lit("LOUD WORDS !!!")).otherwise(F.lit("some plain words and no bar")).alias("text"))
    labels = base.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality.fit(docs, labels)
    low, high = model.score(np.array([quality.features("some plain words | and a bar"), quality.features("some plain words and no bar")]))
    assert low < 0.7 <= high


def test_all_pairs_are_fitted(spark):
    from textloom.llm.quality import _expand, fit_all

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, len(quality.FEATURES)))
    y = (x[:, 0] + rng.normal(size=300) > 0).astype(int)
    model = fit_all(spark.createDataFrame([(bytearray(a.tobytes()), int(b)) for a, b in zip(x, y, strict=True)], "f binary, label int"))
    z = _expand((x - x.mean(0)) / x.std(0))
    difference = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])
    gradient = -(difference.T @ (1 / (1 + np.exp(difference @ model.weights)))) / len(difference) + 1e-4 * model.weights
    assert np.abs(gradient).max() < 1e-3
    assert model.quantile == pytest.approx((z @ model.weights < model.threshold).mean(), abs=1e-9)
