"""Association and rate formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(n: Column, total: Column, per: float, decimals: int) -> Column:
    """n of total, per so many; 0 where total is 0."""
    return F.when(total > 0, F.round(n / total * F.lit(float(per)), decimals)).otherwise(F.lit(0.0))


def per_million(n: Column, total: Column, decimals: int = 2) -> Column:
    return rate(n, total, 1e6, decimals)


def _cell(observed: Column, expected: Column) -> Column:
    return F.when((observed == 0) | (expected == 0), F.lit(0.0)).otherwise(observed * F.log(observed / expected))


def log_likelihood(o11: Column, o12: Column, o21: Column, o22: Column) -> Column:
    """Dunning's G2 of a 2 x 2 table, not rounded and without a sign."""
    o11, o12, o21, o22 = (o.cast("double") for o in (o11, o12, o21, o22))
    n = o11 + o12 + o21 + o22
    rows, columns = (o11 + o12, o21 + o22), (o11 + o21, o12 + o22)
    cells = ((o11, 0, 0), (o12, 0, 1), (o21, 1, 0), (o22, 1, 1))
    total = F.lit(0.0)
    for o, i, j in cells:
        total = total + _cell(o, rows[i] * columns[j] / n)
    return F.when(n > 0, 2 * total).otherwise(F.lit(0.0))


def signed_keyness(o11: Column, o12: Column, o21: Column, o22: Column, decimals: int = 4) -> Column:
    """G2, positive where the first corpus has the higher rate (ties count as that)."""
    g2 = log_likelihood(o11, o12, o21, o22)
    more = o11 / (o11 + o21 + F.lit(1e-9)) >= o12 / (o12 + o22 + F.lit(1e-9))
    return F.round(F.when(more, g2).otherwise(-g2), decimals) + F.lit(0.0)  # no negative zero


def pmi(cofreq: Column, total: Column, freq_a: Column, freq_b: Column) -> Column:
    """log2 of the joint over the product of the single probabilities; -infinity for a pair that never occurs."""
    value = F.log2((cofreq / total) / ((freq_a / total) * (freq_b / total)))
    return F.when((cofreq == 0) | (freq_a == 0) | (freq_b == 0), F.lit(float("-inf"))).otherwise(value)


def change_label(before: Column, after: Column) -> Column:
    """Change in percent as text: ±0%, n/a where both are absent, ∞ where only the first is."""
    change = F.concat(F.format_string("%+.1f", (after - before) / before * 100), F.lit("%"))
    return F.when((before == 0) & (after == 0), F.lit("n/a")).when(before == 0, F.lit("∞")).when(before == after, F.lit("±0%")).otherwise(change)


def jaccard(a: Column, b: Column, decimals: int = 4) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.round(F.size(F.array_intersect(a, b)) / union, decimals)).otherwise(F.lit(0.0))
