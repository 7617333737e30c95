"""Report tables with numbers only, rendered as one Markdown text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import YEAR, truncated
from textloom.operators.frequency import top_k
from textloom.sources.writers import markdown


def yearly(df: DataFrame, name: str, measure: str) -> DataFrame:
    """slice, n, mean, least and most of a measure; the slice comes from a name."""
    year = F.regexp_extract(name, YEAR, 1)
    grouped = df.withColumn("slice", F.when(year != "", year)).where("slice is not null").groupBy("slice")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(measure), 2).alias("mean"), F.min(measure).alias("min"), F.max(measure).alias("max"))


def section(title: str, df: DataFrame, right=(), level: int = 2) -> str:
    return f"{'#' * level} {title}\n\n{markdown(df, right)}\n"


def report(tables: dict[str, DataFrame]) -> str:
    return "\n".join(section(title, df, [c for c, kind in df.dtypes if kind != "string"]) for title, df in tables.items())


def best_per(df: DataFrame, by: str, measure: str, tie: str, k: int = 10) -> DataFrame:
    return top_k(df, k, [by], [F.desc(measure), tie]).orderBy(by, "rank")


def numbered(df: DataFrame, by: str, order: Sequence, text: Column, k: int = 3, cut: int = 300) -> DataFrame:
    """by, rank, quotation: the first k texts of each value of ``by``, cut to ``cut`` characters."""
    best = top_k(df.where(F.col(by).isNotNull()).withColumn("_text", text), k, [by], order)
    return best.select(by, "rank", truncated(F.col("_text"), cut).alias("quotation"))


def strongest_seeds(grid: DataFrame, k: int = 10) -> DataFrame:
    """slice, rank, term, category, abs, per_million (one decimal): the k seed terms of the highest rate in each slice."""
    best = top_k(grid, k, ["slice"], [F.desc("per_million"), "term"])
    return best.select("slice", "rank", "term", "category", "abs", F.round("per_million", 1).alias("per_million"))
