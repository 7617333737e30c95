"""Context windows around anchor tokens: category counts, term matrices, citations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import edge_stripped, full_match, space_tokens, unnested
from textloom.operators.collocations import around
from textloom.operators.frequency import top_k


def anchor_places(tokens: Column, anchor: str) -> Column:
    """Indices (from 0) of the tokens that, without punctuation at their edges, wholly match ``anchor``."""
    tested = F.transform(tokens, lambda x, i: F.when(full_match(edge_stripped(x), anchor), i))
    return F.array_compact(tested)


def anchor_windows(docs: DataFrame, anchor: str, window: int) -> DataFrame:
    """slice, doc_id, pos, context: a row for each token that, without punctuation at its edges, wholly matches ``anchor``; the
    context holds the anchor and raw punctuation."""
    rows = docs.select("slice", "doc_id", space_tokens("text").alias("t"))
    hits = F.filter(F.transform("t", lambda x, i: F.struct(i.alias("i"), full_match(edge_stripped(x), anchor).alias("m"))), lambda x: x["m"])
    each = unnested(rows, hits, "h", "slice", "doc_id", "t")
    return each.select("slice", "doc_id", F.col("h.i").alias("pos"), F.array_join(around(F.col("t"), F.col("h.i"), window, inclusive=True), " ").alias("context"))


def category_counts(windows: DataFrame, categories: Sequence[tuple[str, str]]) -> DataFrame:
    """slice, anchors, and for each category the matches in all windows and those per 100 anchors; overlapping windows recount."""
    sums = [F.sum(F.regexp_count("context", F.lit(p))).alias(n) for n, p in categories]
    grouped = windows.where("slice is not null").groupBy("slice").agg(F.count(F.lit(1)).alias("anchors"), *sums)
    return grouped.select("slice", "anchors", *[n for n, _ in categories], *[F.round(F.col(n) / F.greatest("anchors", F.lit(1)) * 100, 2).alias(f"{n}_norm") for n, _ in categories])


def term_matrix(windows: DataFrame, terms: Sequence[tuple[str, str]], slices: Sequence) -> DataFrame:
    """term and its raw matches in each slice's windows."""
    sums = windows.where(F.col("slice").isin(list(slices))).groupBy("slice").agg(*[F.sum(F.regexp_count("context", F.lit(p))).alias(n) for n, p in terms])
    long = sums.select("slice", F.explode(F.array(*[F.struct(F.lit(n).alias("term"), F.col(n).alias("n")) for n, _ in terms])).alias("x")).select("slice", "x.*")
    wide = long.groupBy("term").pivot("slice", list(slices)).agg(F.sum("n"))
    return wide.select("term", *[F.coalesce(F.col(f"`{s}`"), F.lit(0)).alias(f"y{s}") for s in slices])


def window_citations(windows: DataFrame, terms: Sequence[tuple[str, str]], least: int = 1) -> DataFrame:
    """slice, doc_id, pos, labels, context: windows with at least one term; labels in the order of ``terms``, joined."""
    found = F.array_compact(F.array(*[F.when(F.col("context").rlike(p), F.lit(n)) for n, p in terms]))
    return windows.select("slice", "doc_id", "pos", found.alias("l"), "context").where(F.size("l") >= least).select("slice", "doc_id", "pos", F.array_join("l", "; ").alias("labels"), "context")


def label_counts(cited: DataFrame) -> DataFrame:
    """label, n over the joined labels."""
    return cited.select(F.explode(F.split("labels", "; ")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def first_citations(cited: DataFrame) -> DataFrame:
    """The first citation of each slice and label, by document and place."""
    each = cited.withColumn("label", F.explode(F.split("labels", "; ")))
    return top_k(each, 1, ["slice", "label"], ["doc_id", "pos"]).select("slice", "label", "doc_id", "pos")
