"""The contract queries opN_<name>, each over its whole table, and the pipeline's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, line_dedup, media, ngram_join, oracles, packing, quality, secrets, sharding, toxicity
from .common import table


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, held_out=0)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_texts(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=4, held_out=2)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"), short=True)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.by_bytes(table(spark, sf_dir, "documents"), shards=24)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(table(spark, sf_dir, "documents"))


def media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interleaved sequences of the web pages, summed up."""
    return media.page_summary(table(spark, sf_dir, "pages"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_nearest, op2_toxicity, op3_ngram_join, op4_quality, op5_line_dedup, op6_sharding, op7_media, media_pages, op8_bpe, op9_secrets, op10_packing)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL for nearest neighbours (exact; the search finds all at the sizes where SQL is run), near texts and secrets. Learned scores,
    fuzzy lines, shards in the order of a hash, byte formats, BPE and packing aren't SQL; tests compare with brute force instead."""
    return dict(oracles.SQL)
