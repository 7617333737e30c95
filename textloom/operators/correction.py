"""Ordered pattern rules with a log, error rates before and after, aligned examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import ANY_SENTENCE_END, composed, edit_rate, space_tokens, token_edit_rate

TOTAL = "GESAMT"


def corrected(docs: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """docs with text corrected and n_<k> replacements of the k-th rule (label, regex, replacement with $1).

    Rules apply in order, each to what the ones before left; a rule that replaces a match with itself still counts.
    """
    rows = docs.withColumn("text", composed(F.col("text")))
    for k, (_, pattern, replacement) in enumerate(rules):
        rows = rows.withColumn(f"n_{k}", F.regexp_count("text", F.lit(pattern))).withColumn("text", F.regexp_replace("text", pattern, replacement))
    return rows


def rule_log(corrections: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """label, n for every rule, most first, and their sum as GESAMT."""
    sums = corrections.agg(*[F.coalesce(F.sum(f"n_{k}"), F.lit(0)).alias(f"n_{k}") for k in range(len(rules))])
    long = sums.select(F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"n_{k}").alias("n")) for k, (label, *_) in enumerate(rules)])).alias("x")).select("x.*")
    grouped = long.groupBy("label").agg(F.sum("n").alias("n"))
    return grouped.unionByName(grouped.agg(F.lit(TOTAL).alias("label"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))).orderBy((F.col("label") == TOTAL).asc(), F.desc("n"), "label")


def error_rates(pairs: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """name, cer_before, cer_after, cer_delta, wer_before, wer_after, wer_delta, and a row with the means of the rounded values.

    pairs: (name, reference, text), compared whole.
    """
    ready = pairs.select("name", "reference", F.col("text").alias("before")).withColumn("text", F.col("before"))
    fixed = corrected(ready, rules).select("name", "reference", "before", F.col("text").alias("after"))
    rates = fixed.select("name", *[f(F.col("reference"), F.col(c)).alias(f"{n}_{c}") for n, f in (("cer", edit_rate), ("wer", token_edit_rate)) for c in ("before", "after")])
    columns = ["name", "cer_before", "cer_after", "cer_delta", "wer_before", "wer_after", "wer_delta"]
    made = rates.withColumn("cer_delta", F.round(F.col("cer_after") - F.col("cer_before"), 2)).withColumn("wer_delta", F.round(F.col("wer_after") - F.col("wer_before"), 2)).select(*columns)
    made = made.repartition("name")  # rates are found once: rows and their means read the same exchange
    mean = made.agg(F.format_string("DURCHSCHNITT (%d)", F.count(F.lit(1))).alias("name"), *[F.round(F.avg(c), 2).alias(c) for c in columns[1:]])
    return made.unionByName(mean)


def changed_sentences(before: DataFrame, after: DataFrame, k: int = 5, least: int = 5) -> DataFrame:
    """doc_id, pos, before, after: sentences aligned by place, up to the shorter text, that differ and have ``least`` words; the
    first k. Here a sentence ends at a stop and white space, whatever follows."""
    cut = lambda c: F.split(c, ANY_SENTENCE_END)
    joined = before.select("doc_id", cut("text").alias("b")).join(after.select("doc_id", cut("text").alias("a")), "doc_id")
    pairs = joined.select("doc_id", F.posexplode(F.arrays_zip("b", "a")).alias("pos", "x")).where("x.b is not null and x.a is not null and x.b <> x.a").where(F.size(space_tokens("x.b")) >= least)
    return pairs.select("doc_id", "pos", F.col("x.b").alias("before"), F.col("x.a").alias("after")).orderBy("doc_id", "pos").limit(k)
