"""Parameterised questions an analyst asks of result tables: filters that may be absent, a sort, a cut."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import contains_any
from textloom.operators.frequency import pivoted

ANY = "Alle"


def where_given(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters; None and "Alle" mean any value."""
    for column, value in wanted.items():
        if value is not None and value != ANY:
            df = df.where(F.col(column) == F.lit(value))
    return df


def find_terms(frequencies: DataFrame, term: str = "", k: int = 50, column: str = "token") -> DataFrame:
    """Terms that contain ``term``, most frequent first. The search is literal and ignores case."""
    found = frequencies.where(contains_any([column], term)) if term else frequencies
    return found.orderBy(F.desc("abs"), column).limit(k)


def top_seed_pivot(grid: DataFrame, slices: Sequence, k: int = 10) -> DataFrame:
    """The k seed terms with most occurrences, by slice."""
    best = grid.groupBy("term").agg(F.sum("abs").alias("n")).orderBy(F.desc("n"), "term").limit(k)
    return pivoted(grid.join(F.broadcast(best.select("term")), "term", "left_semi"), ["term"], "slice", slices, "abs")


def keyword_table(scored: DataFrame, transition: str | None = None, direction: str | None = None, k: int = 20) -> DataFrame:
    """The terms with the strongest g2 in a direction."""
    return where_given(scored, transition=transition, direction=direction).orderBy(F.desc(F.abs("g2")), "transition", "token").limit(k)


def keyword_seed_pivot(scored: DataFrame, seeds: Sequence[str], transitions: Sequence[str]) -> DataFrame:
    """Mean g2 of seed terms by transition, null where a term isn't scored."""
    wide = scored.where(F.col("token").isin(list(seeds))).groupBy("token").pivot("transition", list(transitions)).agg(F.avg("g2"))
    return wide.select("token", *[F.col(f"`{t}`").alias(f"t{k}") for k, t in enumerate(transitions)])


def ngram_table(counts: DataFrame, n: int | None = None, scope: str | None = None, k: int = 30) -> DataFrame:
    return where_given(counts, n=n, scope=scope).orderBy(F.desc("abs"), "scope", "ngram").limit(k)


def collocate_table(scored: DataFrame, target: str, scope: str = "gesamt", measure: str = "ll", k: int = 20) -> DataFrame:
    return where_given(scored, target=target, scope=scope).orderBy(F.desc(measure), "collocate").limit(k)


def topic_labels(terms: DataFrame, n: int = 3) -> DataFrame:
    """topic, label: its first n terms."""
    listed = terms.where(F.col("rank") <= n).groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t"))
    return listed.select("topic", F.array_join(F.transform("t", lambda x: x["term"]), ", ").alias("label"))


def share_heat_map(shares: DataFrame, slices: Sequence) -> DataFrame:
    """topic and its mean share in each slice."""
    return pivoted(shares, ["topic"], "slice", slices, "mean_share", 0.0)
