"""Sentence levels and sentence polarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.joins import small
from textloom.functions.text import sentences, unnested_at, word_tokens
from textloom.operators.frequency import top_k


def sentence_rows(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, slice, pos, sentence; the position is among the sentences that are long enough."""
    return unnested_at(docs, sentences("text", least), "pos", "sentence", "doc_id", "slice")


def levels(rows: DataFrame, anchor: str, patterns: Sequence[tuple[int, str]]) -> DataFrame:
    """Sentences that contain ``anchor`` with the highest level whose pattern they contain, 0 if none."""
    level = F.lit(0)
    for n, p in sorted(patterns):
        level = F.when(F.col("sentence").rlike(p), F.lit(n)).otherwise(level)
    return rows.where(F.col("sentence").rlike(anchor)).withColumn("level", level)


def level_shares(leveled: DataFrame, count: int = 4) -> DataFrame:
    """slice, total, and for each level its sentences and their percentage."""
    grouped = leveled.where("slice is not null").groupBy("slice").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("level") == n).alias(f"s{n}") for n in range(count)])
    return grouped.select("slice", "total", *[f"s{n}" for n in range(count)], *[F.round(F.col(f"s{n}") / F.greatest("total", F.lit(1)) * 100, 1).alias(f"s{n}_pct") for n in range(count)])


def level_examples(leveled: DataFrame, k: int = 3, cut: int = 280) -> DataFrame:
    """The k first sentences of each slice and level."""
    return top_k(leveled.withColumn("sentence", F.left("sentence", F.lit(cut))), k, ["slice", "level"], ["doc_id", "pos"]).select("slice", "level", "rank", "doc_id", "sentence")


def polarity(rows: DataFrame, lexicon: DataFrame, anchor: str | None = None, cut: int = 500) -> DataFrame:
    """Sentences (those with ``anchor``, if given) with the mean weight of their words found in lexicon (word, weight); 0 if none.

    Words travel by the lexicon's key with a broadcast lexicon, sums come back by sentence.
    """
    kept = rows if anchor is None else rows.where(F.col("sentence").rlike(anchor))
    kept = kept.withColumn("sentence", F.left("sentence", F.lit(cut)))
    words = kept.select("doc_id", "slice", "pos", "sentence", F.xxhash64("sentence").alias("_h"), F.explode_outer(word_tokens("sentence")).alias("word"))
    scored = words.join(small(lexicon.select("word", "weight")), "word", "left")
    made = scored.groupBy("doc_id", "slice", "pos", "_h").agg(F.first("sentence").alias("sentence"), F.round(F.coalesce(F.avg("weight"), F.lit(0.0)), 6).alias("polarity"))
    return made.drop("_h")


def polarity_statistics(scored: DataFrame) -> DataFrame:
    """slice, n, mean, median, population deviation, least, most, and the shares below, above and at 0 in percent."""
    p = F.col("polarity")
    share = lambda c: F.round(F.count_if(c) / F.count(F.lit(1)) * 100, 2)
    return scored.where("slice is not null").groupBy("slice").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 4).alias("mean"), F.round(F.percentile(p, 0.5), 4).alias("median"), F.round(F.stddev_pop(p), 4).alias("std"),
        F.min(p).alias("min"), F.max(p).alias("max"), share(p < 0).alias("share_neg"), share(p > 0).alias("share_pos"), share(p == 0).alias("share_neu"),
    )


def extremes(scored: DataFrame, k: int = 3) -> DataFrame:
    """The k lowest sentences of each slice."""
    return top_k(scored.where("slice is not null"), k, ["slice"], ["polarity", "doc_id", "pos"]).select("slice", "rank", "doc_id", "pos", "polarity")
