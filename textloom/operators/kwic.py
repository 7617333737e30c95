"""Concordances: keyword in context on raw tokens, and pattern citations by character offset."""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import contains_any, space_tokens, truncated


def kwic(docs: DataFrame, targets: Sequence[tuple[str, str]], window: int = 30) -> DataFrame:
    """target, slice, doc_id, keyword, left, right, concordance, pos_in_doc (from 0) for targets (name, regex).

    Tokens are parts between white space; a token is a hit once per target whose pattern it contains. Only hits carry their window.
    """
    rows = docs.select("doc_id", "slice", space_tokens("text").alias("t"))
    tested = F.array(*[F.struct(F.lit(n).alias("n"), F.filter(F.transform("t", lambda x, i: F.struct(i.alias("i"), x.alias("k"))), _token_matches(p)).alias("h")) for n, p in targets])
    hits = rows.select("doc_id", "slice", "t", F.explode(tested).alias("x")).select("doc_id", "slice", "t", F.col("x.n").alias("target"), F.explode("x.h").alias("h"))
    first = F.greatest(F.col("h.i") - window, F.lit(0))
    left = F.array_join(F.slice("t", first + 1, F.col("h.i") - first), " ")
    right = F.array_join(F.slice("t", F.col("h.i") + 2, F.lit(window)), " ")
    made = hits.select("target", "slice", "doc_id", F.col("h.k").alias("keyword"), left.alias("left"), right.alias("right"), F.col("h.i").alias("pos_in_doc"))
    return made.select("target", "slice", "doc_id", "keyword", "left", "right", F.concat("left", F.lit("  ["), "keyword", F.lit("]  "), "right").alias("concordance"), "pos_in_doc")


def _token_matches(pattern: str):
    return lambda x: x["k"].rlike(pattern)


def kwic_statistics(hits: DataFrame, slices: Sequence) -> DataFrame:
    """target, a count for each slice, total, and the slice with most hits (the first of ties)."""
    wide = hits.where(F.col("slice").isNotNull()).groupBy("target").pivot("slice", list(slices)).count()
    named = wide.select("target", *[F.coalesce(F.col(f"`{s}`"), F.lit(0)).alias(f"n_{s}") for s in slices])
    counts = F.array(*[F.col(f"n_{s}") for s in slices])
    best = F.element_at(F.lit(list(slices)), F.array_position(counts, F.array_max(counts)).cast("int"))
    return named.withColumn("total", sum((F.col(f"n_{s}") for s in slices), F.lit(0))).withColumn("peak", best)


def kwic_search(hits: DataFrame, target: str | None = None, slice_value=None, term: str | None = None, limit: int | None = None) -> DataFrame:
    """Hits of a target and slice (None: any) whose context has the term, in order of document and place."""
    found = hits
    if target is not None:
        found = found.where(F.col("target") == target)
    if slice_value is not None:
        found = found.where(F.col("slice") == slice_value)
    if term:
        found = found.where(contains_any(["left", "right"], term))
    ordered = found.orderBy(F.coalesce("slice", F.lit(9999)), "doc_id", "pos_in_doc")
    return ordered.limit(limit) if limit is not None else ordered


def kwic_sheets(hits: DataFrame, targets: Sequence[str], slices: Sequence) -> dict[str, DataFrame]:
    """The tables of a workbook: all hits, each target's (names of at most 31 characters), and the statistics."""
    sheets = {"all": hits} | {t[:31]: hits.where(F.col("target") == t) for t in targets}
    return sheets | {"statistics": kwic_statistics(hits, slices)}


CITATION = "doc_id long, slice int, pattern string, start int, end int, match string, context string"
CITATIONS_AT_ONCE = 1000


def citations(docs: DataFrame, patterns: Sequence[tuple[str, str]], words: int = 15) -> DataFrame:
    """Every match of every pattern (label, Python regex) with ``words`` words on both sides of it; [TREFFER] marks it.

    Offsets of all matches have no Spark expression for Python patterns, so this runs in Arrow batches; a text is parted into words
    once, and the words beside a match are found by their places.
    """
    marks = list(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re
        from bisect import bisect_left, bisect_right

        compiled, word = [(label, re.compile(p, re.IGNORECASE)) for label, p in marks], re.compile(r"\S+")
        schema = pa.schema([("doc_id", pa.int64()), ("slice", pa.int32()), ("pattern", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("match", pa.string()), ("context", pa.string())])
        full = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        out = []
        for batch in batches:
            # texts become strings one at a time, and only those with a match are parted into words
            for doc, part, value in zip(batch["doc_id"], batch["slice"], batch["text"], strict=True):
                text = value.as_py()
                found = [(label, m) for label, pattern in compiled for m in pattern.finditer(text)]
                if not found:
                    continue
                doc, part = doc.as_py(), part.as_py()
                spans = array("q", [x for m in word.finditer(text) for x in m.span()])
                starts, ends = spans[::2], spans[1::2]
                for label, m in found:
                    before, after = bisect_left(starts, m.start()), bisect_right(ends, m.end())
                    left = " ".join(text[starts[k] : min(ends[k], m.start())] for k in range(max(0, before - words), before))
                    right = " ".join(text[max(starts[k], m.end()) : ends[k]] for k in range(after, min(len(ends), after + words)))
                    out.append((doc, part, label, m.start(), m.end(), m[0], f"{left} [TREFFER] {m[0]} [/TREFFER] {right}".strip()))
                    if len(out) == CITATIONS_AT_ONCE:
                        yield full(out)
                        out = []
        if out:
            yield full(out)

    ready = docs.select(F.col("doc_id").cast("long"), F.col("slice").cast("int"), F.coalesce("text", F.lit("")).alias("text"))
    return ready.mapInArrow(run, CITATION)


def shortened(hits: DataFrame, column: str, n: int) -> DataFrame:
    return hits.withColumn(column, truncated(F.col(column), n))
