"""Quality by Bradley-Terry ranking: P(a over b) = logistic(w . (f(a) - f(b))) fitted on preference pairs.

Pairs are training documents labelled 1 and 0, all of them. The fitted utility orders documents; the threshold is a quantile of the
training utilities (given, or the one that parts the labels best), and utilities are mapped so that it becomes 0.7.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .labels import fold_of

FEATURES = (
    "log_chars", "upper", "digit", "mark", "odd_mark", "space", "newline", "word_length", "word_length_spread", "distinct_words", "top_word",
    "same_as_previous", "same_as_second", "marks_run", "bar", "long_words", "short_words", "end_marked_words", "capital_words", "words_per_line", "end_sentence", "few_words", "non_ascii", "distinct_trigrams", "repeated_lines",
)
_RUN = re.compile(r"[!#$%&*+=?@^~|<>{}\[\]\\/]{2,}")
_COMMON = frozenset(".,;:!?'\"()- ")


def features(text: str) -> list[float]:
    n = max(1, len(text))
    words = text.split()
    m = max(1, len(words))
    counts = Counter(words)
    chars = Counter(text)
    marks = {c: k for c, k in chars.items() if not (c.isalnum() or c.isspace())}
    lengths = np.fromiter(map(len, words), dtype=float, count=len(words)) if words else np.zeros(1)
    lines = [x for x in text.split("\n") if x.strip()]
    runs = _RUN.findall(text)
    triples = len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, len(words) - 2)
    return [
        np.log1p(len(text)),
        sum(k for c, k in chars.items() if c.isupper()) / n,
        sum(k for c, k in chars.items() if c.isdigit()) / n,
        sum(marks.values()) / n,
        sum(k for c, k in marks.items() if c not in _COMMON) / n,
        chars[" "] / n,
        chars["\n"] / n,
        lengths.mean() / 10,
        lengths.std() / 10,
        len(counts) / m,
        max(counts.values(), default=0) / m,
        sum(map(str.__eq__, words[1:], words)) / m,
        sum(map(str.__eq__, words[2:], words)) / m,
        len(runs) / m,
        (chars["|"] + chars["\t"]) / n,
        float((lengths > 20).mean()),
        float((lengths <= 2).mean()),
        sum(not w[-1].isalnum() for w in words) / m,
        sum(w[0].isupper() for w in words) / m,
        min(5.0, m / max(1, len(lines)) / 20),
        sum(x.rstrip()[-1] in ".!?" for x in lines) / max(1, len(lines)),
        1.0 / (1.0 + len(words)),
        sum(k for c, k in chars.items() if c > "\x7f") / n,
        triples,
        1 - len(set(lines)) / max(1, len(lines)),
    ]


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    quantile: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, rising with utility; the threshold is at 0.7."""
        z = np.clip(_expand((x - self.mean) / self.spread) @ self.weights - self.threshold + np.log(0.7 / 0.3), -30, 30)
        return 1 / (1 + np.exp(-z))


def _expand(z: np.ndarray) -> np.ndarray:
    """Standardised features, clipped, beside their squares and absolute values."""
    z = np.clip(z, -6, 6)
    return np.hstack([z, z * z / 6, np.abs(z)])


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = 60_000, rounds: int = 400, ridge: float = 1e-4, seed: int = 42, quantile: float | None = None) -> QualityModel:
    """Fit on arrays with so many pairs drawn; tables are fitted by fit_all."""
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = _expand((x - mean) / spread)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    weights = np.zeros(z.shape[1])
    if len(good) and len(bad):
        rng = np.random.default_rng(seed)
        difference = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        momentum, scale = np.zeros_like(weights), np.zeros_like(weights)
        for t in range(1, rounds + 1):  # Adam on the whole logistic loss
            p = 1 / (1 + np.exp(np.clip(difference @ weights, -30, 30)))
            gradient = -(difference.T @ p) / pairs + ridge * weights
            momentum = 0.9 * momentum + 0.1 * gradient
            scale = 0.999 * scale + 0.001 * gradient**2
            weights = weights - 0.05 * (momentum / (1 - 0.9**t)) / (np.sqrt(scale / (1 - 0.999**t)) + 1e-8)
    utility = z @ weights
    if quantile is None:
        quantile = parting_quantile(utility, y) if len(good) and len(bad) else 0.0
    threshold = float(np.quantile(utility, quantile)) if len(good) and len(bad) else 0.0
    return QualityModel(mean, spread, weights, threshold, quantile)


def parting_quantile(utility: np.ndarray, y: np.ndarray) -> float:
    """The share of documents to cut off for which those labelled 0 below exceed those labelled 1 below by the most."""
    order = np.argsort(utility, kind="stable")
    lost, caught = np.r_[0, np.cumsum(y[order] == 1)] / (y == 1).sum(), np.r_[0, np.cumsum(y[order] == 0)] / (y == 0).sum()
    best = np.flatnonzero(caught - lost == (caught - lost).max())
    return float(np.clip((best[len(best) // 2] - 0.5) / max(1, len(y) - 1), 0.0, 1.0))


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, f) of every document, f its features as doubles in bytes; written once, since fitting and scoring read it."""

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(features(t), dtype=float).tobytes() for t in texts], dtype=object)

    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), packed(F.coalesce("text", F.lit(""))).alias("f")), "zstd")


def _unpacked(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=float).reshape(len(column), len(FEATURES))


def _summed(rows: DataFrame, make) -> np.ndarray | None:
    """The sum of make(features, labels), arrays of one length, over all rows; a task sends one array."""

    def run(frames):
        total = None
        for pdf in frames:
            if len(pdf):
                part = make(_unpacked(pdf["f"]), pdf["label"].to_numpy())
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"sum": [total.tobytes()]})

    parts = [np.frombuffer(r["sum"], dtype=float) for r in rows.mapInPandas(run, "sum binary").collect()]
    return np.sum(parts, axis=0) if parts else None


def _cells(u: np.ndarray, y: np.ndarray, low: float, step: float, cells: int) -> np.ndarray:
    """Documents labelled 0 and 1 by cell of utility, each shared by the two nearest cells."""
    at = np.clip((u - low) / step, 0, cells - 1.001)
    k, share = at.astype(np.int64), at % 1
    out = np.zeros((2, cells))
    for label in (0, 1):
        own = y == label
        out[label] = np.bincount(k[own], 1 - share[own], cells) + np.bincount(k[own] + 1, share[own], cells)
    return out.ravel()


def fit_all(rows: DataFrame, quantile: float | None = None, rounds: int = 20, ridge: float = 1e-4, cuts: int = 1 << 16) -> QualityModel:
    """Fit on all rows (f, label) and all pairs of a document labelled 1 and one labelled 0.

    The loss of all pairs depends on utilities only through how many documents of a label have which, so it comes from counts on a
    grid of 1/16 (off by less than 5e-5 a pair), and the gradient from a weight for each document, looked up there. Newton steps;
    pairs by coarse cells serve in their matrix alone. What comes to the driver doesn't grow with the rows. The threshold is the best of
    ``cuts`` even ones, found on counts of all rows.
    """
    width = len(FEATURES)
    sums = _summed(rows, lambda x, y: np.r_[len(x), (y == 1).sum(), (y == 0).sum(), x.sum(0), (x * x).sum(0)])
    if sums is None or not sums[1] or not sums[2]:
        return QualityModel(np.zeros(width), np.ones(width), np.zeros(3 * width), 0.0, 0.0)
    count, good, bad = sums[:3]
    mean = sums[3 : 3 + width] / count
    spread = np.maximum(np.sqrt(np.maximum(sums[3 + width :] / count - mean**2, 0)), 1e-6)
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))

    def state(weights):
        """Loss at these weights, and by cell the first and second derivatives of documents' own losses."""
        reach = 6 * np.abs(weights).sum() + 1
        step = max(1 / 16, reach / (1 << 14))
        cells = int(2 * reach / step) + 3
        n = _summed(rows, lambda x, y: _cells(_expand((x - mean) / spread) @ weights, y, -reach, step, cells)).reshape(2, cells)
        centre = -reach + step * np.arange(cells)
        some = [np.flatnonzero(k) for k in n]
        gap = centre[some[1]][:, None] - centre[some[0]][None, :]
        loss = n[1][some[1]] @ np.logaddexp(0, -gap) @ n[0][some[0]] / good / bad + ridge / 2 * weights @ weights
        p = sigmoid(-gap)
        slope, bend = np.zeros((2, cells)), np.zeros((2, cells))
        slope[1][some[1]], slope[0][some[0]] = -p @ n[0][some[0]] / good / bad, n[1][some[1]] @ p / good / bad
        bend[1][some[1]], bend[0][some[0]] = (p * (1 - p)) @ n[0][some[0]] / good / bad, n[1][some[1]] @ (p * (1 - p)) / good / bad
        return loss, reach, step, cells, slope, bend

    def derivatives(weights, reach, step, cells, slope, bend, coarse=129):
        size = 3 * width

        def make(x, y):
            z = _expand((x - mean) / spread)
            u = z @ weights
            at = np.clip((u + reach) / step, 0, cells - 1.001)
            k, share, label = at.astype(np.int64), at % 1, (y == 1).astype(np.int64)
            first = slope[label, k] * (1 - share) + slope[label, k + 1] * share
            second = bend[label, k] * (1 - share) + bend[label, k + 1] * share
            cell = np.clip(np.rint(2 * u), -64, 64).astype(np.int64) + 64
            held = np.zeros((2, coarse, size))
            np.add.at(held, (label, cell), z)
            return np.r_[first @ z, ((z * second[:, None]).T @ z).ravel(), held.ravel()]

        found = _summed(rows, make)
        gradient, matrix, held = found[:size] + ridge * weights, found[size : size + size * size].reshape(size, size), found[size + size * size :].reshape(2, coarse, size)
        p = sigmoid((np.arange(coarse)[:, None] - np.arange(coarse)[None, :]) / 2)
        cross = held[1].T @ (p * (1 - p)) @ held[0] / good / bad
        value, vector = np.linalg.eigh(matrix - cross - cross.T + ridge * np.eye(size))
        return gradient, vector @ ((vector.T @ gradient) / np.maximum(value, ridge))

    weights = np.zeros(3 * width)
    loss, *where = state(weights)
    for _ in range(rounds):
        gradient, move = derivatives(weights, *where)
        if np.abs(gradient).max() < 1e-5:
            break
        for part in (1, 0.5, 0.25, 0.1, 0.02):
            lower, *there = state(weights - part * move)
            if lower < loss:
                break
        else:
            break
        gain, weights, loss, where = loss - lower, weights - part * move, lower, there
        if gain < 1e-6:
            break
    reach = where[0]
    edge = np.linspace(-reach, reach, cuts + 1)

    def counts(x, y):
        k = np.clip(np.searchsorted(edge, _expand((x - mean) / spread) @ weights, "right") - 1, 0, cuts - 1)
        return np.concatenate([np.bincount(k[y == label], minlength=cuts) for label in (0, 1)]).astype(float)

    caught, lost = np.cumsum(_summed(rows, counts).reshape(2, cuts), axis=1)
    below = (caught + lost) / (good + bad)
    if quantile is None:
        best = np.flatnonzero((parted := np.round(caught / bad - lost / good, 12)) == parted.max())
        cut = int(best[len(best) // 2])
    else:
        cut = int(np.argmin(np.abs(below - quantile)))
    return QualityModel(mean, spread, weights, float(edge[cut + 1]), float(below[cut]))


def training_features(table: DataFrame, labels: DataFrame, folds: int, held_out: int) -> DataFrame:
    """(f, label) of all labelled documents outside the held-out fold, as a table. Rows with a null id or label are not used; of
    repeated labels of an id the least counts."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
        .where("doc_id is not null and label is not null")
        .where(fold_of(F.col("doc_id"), folds) != held_out)
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    return materialize(table.join(chosen, "doc_id").select("f", "label"), "zstd")


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, quantile: float | None = None) -> QualityModel:
    """Fit on all labelled documents outside the held-out fold; ``quantile`` is the share of them to lie below the threshold, by
    default the one that parts the labels best."""
    return fit_all(training_features(feature_table(docs), labels, folds, held_out), quantile)


def with_score(docs: DataFrame, model: QualityModel, column: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1; null counts as the empty text, whose features are all defined."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))))

    return docs.withColumn(column, score(F.coalesce("text", F.lit(""))))


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, **parameters) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.7) for every row. A null id counts as held out; repeated rows each come back;
    without labels of both kinds every document scores 0.7."""
    rows = feature_table(docs)
    model = fit_all(training_features(rows, labels, folds, held_out), **parameters)

    @F.pandas_udf("double")
    def score(packed: pd.Series) -> pd.Series:
        return pd.Series(model.score(_unpacked(packed)))

    out = F.coalesce(fold_of(F.col("doc_id"), folds) == held_out, F.lit(True))
    return rows.withColumn("score", score("f")).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
