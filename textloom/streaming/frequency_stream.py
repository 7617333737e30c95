"""Term counts over a stream of new documents (an extension: all inputs of the batch operators are finite)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import unnested, word_tokens


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string, slice int", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def term_counts(stream: DataFrame) -> DataFrame:
    """slice, token, abs: counts merge, so the same aggregation serves batches and streams (complete or update mode). The state has a
    row for each slice and token."""
    return unnested(stream.where("slice is not null"), word_tokens("text"), "token", "slice").groupBy("slice", "token").agg(F.count(F.lit(1)).alias("abs"))


def to_table(counts: DataFrame, name: str, checkpoint: str, mode: str = "complete"):
    return counts.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
