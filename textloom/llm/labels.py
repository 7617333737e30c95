"""Labelled documents for fitting: a bounded sample that never holds held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, limit: int) -> DataFrame:
    """(text, label) of at most about ``limit`` labelled documents outside the held-out fold, the first by a hash of their id.

    ``limit`` bounds the narrow side, so it is broadcast, and the rows, which are written as a table: fitting reads them more than
    once, the documents once. Rows with a null id or label are not used; of repeated labels of an
    id the least counts.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where("doc_id is not null and label is not null")
        .where(fold_of(F.col("doc_id"), folds) != held_out)
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return materialize(rows.join(F.broadcast(chosen), "doc_id").select("text", "label"), "zstd")
