"""Lexicon density of documents, and the share of tokens in a vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.joins import small
from textloom.functions.stats import rate
from textloom.functions.text import unnested, word_tokens
from textloom.operators.frequency import top_k


def lexicon_density(docs: DataFrame, lexicon: DataFrame, pattern: str = r"[a-zäöüß]{3,}", forms: int = 5) -> DataFrame:
    """doc_id, slice, density (hits per 1,000 words), n_hits, n_words, top_words for a lexicon (word).

    Documents without words are left out. Only words found in the lexicon go on, so what is grouped by document is small.
    """
    rows = docs.select("doc_id", "slice", word_tokens("text", pattern).alias("w")).withColumn("n_words", F.size("w"))
    words = lexicon.select("word").distinct()
    hits = unnested(rows, "w", "word", "doc_id").join(small(words), "word", "left_semi").groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    sums = hits.groupBy("doc_id").agg(F.sum("n").alias("n_hits"))
    best = top_k(hits, forms, ["doc_id"], [F.desc("n"), F.asc("word")])
    listed = best.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat("word", F.lit("("), "n", F.lit(")")).alias("f")))).alias("f"))
    joined = rows.drop("w").join(sums, "doc_id", "left").join(listed, "doc_id", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    joined = joined.where(F.col("n_words") + F.col("n_hits") > 0)  # on both sides of the join, so that it isn't computed again at the scan
    return joined.select("doc_id", "slice", rate(F.col("n_hits"), F.col("n_words"), 1000, 2).alias("density"), "n_hits", "n_words", F.coalesce(F.array_join(F.transform("f", lambda x: x["f"]), ", "), F.lit("")).alias("top_words"))


def density_statistics(densities: DataFrame, unknown: str = "unbekannt") -> DataFrame:
    """slice (as text, null as unbekannt), n_docs, mean, least and most density."""
    return densities.groupBy(F.coalesce(F.col("slice").cast("string"), F.lit(unknown)).alias("slice")).agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("density"), 2).alias("mean"), F.min("density").alias("min"), F.max("density").alias("max"))


def known_share(docs: DataFrame, vocabulary: DataFrame, decimals: int = 4) -> DataFrame:
    """doc_id, n_words, score: the share of a document's words found in vocabulary (word), 0 without words."""
    rows = docs.select("doc_id", word_tokens("text").alias("w"))
    counts = unnested(rows, "w", "word", "doc_id").groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))  # a document's word once
    hits = counts.join(small(vocabulary.select("word").distinct()), "word", "left_semi").groupBy("doc_id").agg(F.sum("n").alias("n"))
    return rows.select("doc_id", F.size("w").alias("n_words")).join(hits, "doc_id", "left").select("doc_id", "n_words", rate(F.coalesce("n", F.lit(0)), F.col("n_words"), 1, decimals).alias("score"))
