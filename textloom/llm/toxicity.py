"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, exception phrases, normalised by length.

Texts are folded (compatibility decomposition without marks, lower case, look-alike letters of other scripts to Latin, digits and
signs inside words to the letters they stand for). The lexicon's entries are word beginnings with a weight, learned as log odds
from labelled training rows, beside a few fixed English insults. One automaton finds entries and exception phrases; an entry
inside an exception phrase doesn't count. The score is a logistic function of the summed weight per root of the word count.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import fold_of, training_rows

# Insults every lexicon starts with, and phrases in which such words are harmless.
SEEDS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
EXCEPTIONS = ("class clown", "clown car", "clown fish", "pathetic fallacy", "pond scum", "sore loser", "stupid simple", "trash can", "trash bag", "trash collection", "white trash can")

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = str.maketrans(
    "авеікмнорстухѕјԁԛԝһӏүɡɩαβεικνορτυχωıł",
    "abeikmhopctyxsjdqwhlygiabeikvoptuxwil",
)
# Digits and signs that stand for letters inside words; some may stand for i or l.
DIGITS = str.maketrans("0134578@$!|", "oieastbasil")
DIGITS_L = str.maketrans("0134578@$!|", "oleastbasll")
_SUBSTITUTED = re.compile(r"(?<![^\W\d_])[0134578@$]{1,2}(?=[^\W\d_]{2})|(?<=[^\W\d_])[0134578@$!|]{1,3}(?=[^\W\d_])|(?<=[^\W\d_]{2})[01345780@$]{1,2}(?![\w@$!|])")
_AMBIGUOUS = re.compile(r"1|(?<=[^\W\d_])[!|](?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str, digits: dict = DIGITS) -> str:
    """Folded text; after removal of marks and zero-width characters every character keeps its place."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c) and c not in "​‌‍⁠﻿­")
        text = text.lower().translate(LOOK_ALIKES)
    else:
        text = text.lower()
    for _ in range(2):  # letters made first may make digits beside them letters
        text, n = _SUBSTITUTED.subn(lambda m: m[0].translate(digits), text)
        if not n:
            break
    return text


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    exceptions: tuple[str, ...]
    slope: float
    offset: float


def _automaton(weights: dict[str, float], exceptions):
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in exceptions:
        found.add_word(phrase, (len(phrase), 0.0))
    for entry, weight in weights.items():
        found.add_word(entry, (len(entry), weight))
    found.make_automaton()
    return found


def spans(text: str, automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) of entries at word beginnings in folded text, outside exception phrases; the longest at a start."""
    hits: dict[int, tuple[int, float]] = {}
    safe: list[tuple[int, int]] = []
    for last, (n, weight) in automaton.iter(text):
        start = last + 1 - n
        if start and text[start - 1].isalpha():
            continue
        if weight:
            hits[start] = (last + 1, weight)
        elif last + 1 == len(text) or not text[last + 1].isalpha():
            safe.append((start, last + 1))
    out, at, until = [], 0, -1
    safe.sort()
    for s, (e, w) in sorted(hits.items()):
        while at < len(safe) and safe[at][0] <= s:  # until: the furthest end of the phrases that begin at s or before
            until, at = max(until, safe[at][1]), at + 1
        if e > until:
            out.append((s, e, w))
    return out


def density(text: str, automaton) -> float:
    """Summed weight of the found entries per root of the number of words."""
    folded = fold(text)
    found = spans(folded, automaton)
    if _AMBIGUOUS.search(text) and (other := fold(text, DIGITS_L)) != folded:
        found = list({s: (s, e, w) for s, e, w in [*spans(other, automaton), *found]}.values())
    return sum(w for *_, w in found) / math.sqrt(folded.count(" ") + folded.count("\n") + 1) if found else 0.0


def _candidates(frames, letters: tuple[int, int]):
    """Document counts by label of word beginnings of so many letters, for each batch."""
    for pdf in frames:
        count = {0: Counter(), 1: Counter()}
        for text, label in zip(pdf["text"], pdf["label"], strict=True):
            words = set(_WORD.findall(fold(text)))
            count[int(label)].update({w[:k] for w in words for k in range(letters[0], letters[1] + 1) if len(w) >= k})
        entries = [(w, count[1][w], count[0][w]) for w in count[1]] + [(w, 0, n) for w, n in count[0].items() if w not in count[1]]
        yield pd.DataFrame(entries, columns=["entry", "toxic", "clean"])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, limit: int = 12_000, entries: int = 1000, exceptions: tuple[str, ...] = EXCEPTIONS, letters: tuple[int, int] = (3, 10), least_weight: float = 3.0) -> ToxicityModel:
    """Learn weights and calibration from at most ``limit`` labelled documents (see training_rows); what comes to the driver is at
    most 8 * ``entries`` counts and ``limit`` densities. The lexicon has at most ``entries`` learned word beginnings of ``letters``
    letters (least, most; a longer word is met by its beginning) with log odds of ``least_weight`` or more, the commonest in
    documents labelled 1 first."""
    rows = training_rows(docs, labels, "toxic", folds, held_out, limit)
    total = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, clean = total.get(1, 0), total.get(0, 0)
    base = 4.0
    weights = dict.fromkeys(SEEDS, base)
    if toxic and clean:
        counts = rows.mapInPandas(lambda frames: _candidates(frames, letters), "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        least = max(3, round(0.015 * toxic))
        odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
        found = counts.where(F.col("toxic") >= least).withColumn("weight", odds).where(F.col("weight") >= least_weight).orderBy(F.desc("toxic"), F.length("entry"), "entry").limit(8 * entries).collect()
        kept: dict[str, tuple[int, float]] = {}
        for r in found:  # a longer beginning is kept only where no shorter one says as much
            if len(kept) < entries and not any(r["entry"][:k] in kept for k in range(letters[0], len(r["entry"]))):
                kept[r["entry"]] = (r["toxic"], min(8.0, r["weight"]))
        weights |= {w: x for w, (_, x) in kept.items()}
    found_densities = rows.mapInPandas(lambda frames: _densities(frames, weights, exceptions), "label int, x double").toPandas()
    slope, offset = _logistic(found_densities["x"].to_numpy(), found_densities["label"].to_numpy())
    return ToxicityModel(weights, tuple(exceptions), slope, offset)


def _densities(frames, weights, exceptions):
    automaton = _automaton(weights, exceptions)
    for pdf in frames:
        yield pd.DataFrame({"label": pdf["label"], "x": [density(t, automaton) for t in pdf["text"]]})


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5) -> tuple[float, float]:
    """Slope and offset of a ridge logistic fit by Newton steps; defaults where a class is missing."""
    if len(x) == 0 or y.min() == y.max():
        return 4.0, -2.0
    design = np.c_[x, np.ones(len(x))]
    share = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())  # both kinds weigh alike
    beta = np.array([1.0, -1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (share * (p - y)) + ridge * len(x) * beta * [1, 0]
        curve = (design * (share * p * (1 - p))[:, None]).T @ design + np.diag([ridge * len(x), 1e-9])
        step = np.linalg.solve(curve, gradient)
        beta = beta - np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def with_score(docs: DataFrame, model: ToxicityModel, column: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1; null and empty texts get the score of a text without entries."""
    weights, exceptions, slope, offset = model.weights, model.exceptions, model.slope, model.offset

    @F.pandas_udf("double")
    def score(batches: pd.Series) -> pd.Series:
        automaton = _cached_automaton(weights, exceptions)
        x = np.array([density(t, automaton) for t in batches], dtype=float)
        return pd.Series(1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30))))

    return docs.withColumn(column, score(F.coalesce("text", F.lit(""))))


def _cached_automaton(weights, exceptions):
    """One automaton for each worker process and lexicon."""
    import sys

    held = sys.__dict__.setdefault("_textloom_automata", {})
    key = hash((tuple(weights.items()), tuple(exceptions)))
    if key not in held:
        held.clear()
        held[key] = _automaton(weights, exceptions)
    return held[key]


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, **parameters) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5) for every row. A null id counts as held out; repeated rows each come back;
    without labels of both kinds the fixed entries and a default calibration are used."""
    model = fit(docs, labels, folds, held_out, **parameters)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = F.coalesce(fold_of(F.col("doc_id"), folds) == held_out, F.lit(True))
    return with_score(rows, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
