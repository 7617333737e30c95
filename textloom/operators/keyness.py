"""Keyness of terms between slices: signed log-likelihood with ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.stats import per_million, signed_keyness
from textloom.functions.text import unnested

FALLING, RISING = "Absteiger", "Aufsteiger"


def keyness(corpus_df: DataFrame, transitions: Sequence[tuple], least: int = 5) -> DataFrame:
    """transition, token, abs_a, abs_b, pm_a, pm_b, pm_diff, g2, direction for pairs of slices (a, b).

    Counts of both slices come from one aggregation, so no join of vocabularies is needed. Terms with fewer than ``least``
    occurrences in both together are left out. g2 > 0 marks a term that is stronger in a (Absteiger), all others are Aufsteiger;
    pm_diff is the difference of the rounded rates.
    """
    slices = sorted({s for pair in transitions for s in pair})
    kept = corpus_df.where(F.col("slice").isin(slices))
    count = lambda s: F.count_if(F.col("slice") == F.lit(s))
    terms = unnested(kept, "tokens", "token", "slice").groupBy("token").agg(*[count(s).alias(f"n{s}") for s in slices])
    sizes = kept.agg(*[F.coalesce(F.sum(F.when(F.col("slice") == F.lit(s), F.col("n_tokens"))), F.lit(0)).alias(f"t{s}") for s in slices])
    pairs = F.array(*[F.struct(F.lit(f"{a}→{b}").alias("transition"), F.col(f"n{a}").alias("abs_a"), F.col(f"n{b}").alias("abs_b"), F.col(f"t{a}").alias("total_a"), F.col(f"t{b}").alias("total_b")) for a, b in transitions])
    rows = terms.crossJoin(sizes).select("token", F.explode(pairs).alias("p")).select("token", "p.*").where(F.col("abs_a") + F.col("abs_b") >= least)
    a, b = F.col("abs_a"), F.col("abs_b")
    scored = rows.withColumn("pm_a", per_million(a, F.col("total_a"))).withColumn("pm_b", per_million(b, F.col("total_b"))).withColumn("g2", signed_keyness(a, b, F.col("total_a") - a, F.col("total_b") - b))
    direction = F.when(F.col("g2") > 0, F.lit(FALLING)).otherwise(F.lit(RISING))
    return scored.select("transition", "token", "abs_a", "abs_b", "pm_a", "pm_b", F.round(F.col("pm_b") - F.col("pm_a"), 2).alias("pm_diff"), "g2", direction.alias("direction"))


def ranked(scored: DataFrame) -> DataFrame:
    """With rank_rising and rank_falling by g2 in each transition; ties share the least rank.

    Ranks are found on the distinct scores, whose counts are summed up within steps of the root of g2 and then over the steps, so no
    task holds a transition's terms, and equal scores, however many terms share one, are one row.
    """
    step = (F.signum("g2") * F.floor(F.sqrt(F.abs("g2")) * 256)).cast("long")
    scores = scored.groupBy("transition", "g2").agg(F.count(F.lit(1)).alias("_n")).withColumn("_s", step)
    counts = scores.groupBy("transition", "_s").agg(F.sum("_n").alias("_n"))
    by, within = Window.partitionBy("transition"), Window.partitionBy("transition", "_s")
    before = lambda w, order: F.coalesce(F.sum("_n").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("transition", "_s", before(by, F.asc("_s")).alias("_below"), before(by, F.desc("_s")).alias("_above"))
    inner = scores.select("transition", "g2", "_s", before(within, F.asc("g2")).alias("_up"), before(within, F.desc("g2")).alias("_down"))
    ranks = inner.join(offsets, ["transition", "_s"]).select("transition", "g2", (F.col("_below") + F.col("_up") + 1).alias("rank_rising"), (F.col("_above") + F.col("_down") + 1).alias("rank_falling"))
    return scored.join(ranks, ["transition", "g2"])


def strongest(scored: DataFrame, k: int = 10) -> DataFrame:
    """The k strongest terms of each transition and direction."""
    w = Window.partitionBy("transition", "direction").orderBy(F.desc(F.abs("g2")), "token")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
