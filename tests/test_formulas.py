"""Formulas on numbers with known results."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import stats
from textloom.functions.text import edit_rate, sentences, space_tokens, stem_pattern, token_edit_rate, word_tokens


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(("co", "target", "other", "total", "ll", "pmi"), [(213, 2013, 522, 525359, 1689.9826, 6.7346), (149, 2013, 177, 525359, 1515.0986, 7.7794)])
def test_association(spark, co, target, other, total, ll, pmi):
    c, t, o, n = (F.lit(x) for x in (co, target, other, total))
    found = one(spark, F.round(stats.log_likelihood(c, t - c, o - c, n - t - o + c), 4), F.round(stats.pmi(c, n, t, o), 4))
    assert found == (ll, pmi)


@pytest.mark.parametrize(("n", "total", "per", "digits", "value"), [(1, 123496, 1e6, 2, 8.10), (527, 525359, 1e6, 2, 1003.12), (299, 8921, 1000, 2, 33.52), (329, 821, 100, 2, 40.07), (624, 708, 100, 1, 88.1), (3, 0, 100, 1, 0.0)])
def test_rates(spark, n, total, per, digits, value):
    assert one(spark, stats.rate(F.lit(n), F.lit(total), per, digits))[0] == value


def test_keyness_sign_and_symmetry(spark):
    a = one(spark, stats.signed_keyness(F.lit(30), F.lit(10), F.lit(970), F.lit(990)))[0]
    b = one(spark, stats.signed_keyness(F.lit(10), F.lit(30), F.lit(990), F.lit(970)))[0]
    assert a > 0 and a == -b


def test_pmi_of_nothing(spark):
    assert one(spark, stats.pmi(F.lit(0), F.lit(10), F.lit(1), F.lit(1)))[0] == float("-inf")


def test_jaccard(spark):
    a, b = F.lit([str(i) for i in range(15)]), F.lit([str(i) for i in range(12, 27)])
    assert one(spark, stats.jaccard(a, b))[0] == 0.1111


def test_words_are_unicode(spark):
    assert one(spark, word_tokens(F.lit("Über Müßige, über ÜBER.")))[0] == ["über", "müßige", "über", "über"]
    assert one(spark, F.regexp_count(F.lit("ÜBEL übelst Kübel"), F.lit(stem_pattern("übel"))))[0] == 2
    assert one(spark, F.size(word_tokens(F.lit(None).cast("string"))))[0] == 0


def test_sentences_need_a_capital(spark):
    assert one(spark, sentences(F.lit("Eins ist da. zwei folgt. Drei kam! Vier")))[0] == ["Eins ist da. zwei folgt.", "Drei kam!", "Vier"]


def test_sentences_keep_figures_at_their_ends(spark):
    assert one(spark, sentences(F.lit("0 is it. Is it 1. A 21 of 12 \u3000")))[0] == ["0 is it.", "Is it 1.", "A 21 of 12"]
    assert one(spark, sentences(F.lit("One.\x0bTwo")))[0] == ["One.\x0bTwo"]


def test_space_tokens(spark):
    assert one(spark, space_tokens(F.lit("  a,  b\n c ")))[0] == ["a,", "b", "c"]


def test_error_rates(spark):
    assert one(spark, edit_rate(F.lit("Straße"), F.lit("Strasse")))[0] == 33.33
    assert one(spark, token_edit_rate(F.lit("a b c d"), F.lit("a x c")))[0] == 50.0
    assert one(spark, token_edit_rate(F.lit(""), F.lit("a")))[0] == 100.0


def test_change_labels(spark):
    found = one(spark, *[stats.change_label(F.lit(a), F.lit(b)) for a, b in ((0, 0), (0, 3), (2, 2), (2, 3))])
    assert found == ("n/a", "∞", "±0%", "+50.0%")


def test_distances_by_bounds_and_diagonals_are_exact():
    import random

    from textloom.functions import distance

    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, d in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (c != d))
        return row[-1]

    rng = random.Random(1)
    for t in range(300):
        letters = "ab" if t % 2 else "aeßth"
        a = "".join(rng.choice(letters) for _ in range(rng.randint(1, 50)))
        b = "".join(rng.choice(letters) if rng.random() < 0.2 else c for c in a if rng.random() < 0.9) if t % 3 else "".join(rng.choice(letters) for _ in range(rng.randint(1, 50)))
        n, (x, y) = brute(a, b), distance._numbers(a, b)
        assert distance.sequence_distance(a, b) == distance.sequence_distance(list(a), list(b)) == n
        if x.size and y.size:
            assert distance._diagonals(x, y, 100) == distance._bit_parallel(x.tolist(), y.tolist()) == n
            assert distance._least(x, y) <= n <= distance._aligned(x, y)


def test_many_differences_in_a_long_text_take_no_table(monkeypatch):
    import random

    from textloom.functions import distance

    monkeypatch.setattr(distance, "_bit_parallel", None)
    rng = random.Random(3)
    text = "".join(rng.choice("aehrst nio.") for _ in range(300_000))
    assert distance.sequence_distance(text, text.replace("th", "t")) == text.count("th")
    assert distance.sequence_distance(text, text.replace("th", "t").replace("ss", "ß")) == text.count("th") + text.replace("th", "t").count("ss") * 2
