"""Slices, tokens and the corpus table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.joins import MOST_ROWS
from textloom.functions.text import YEAR, as_column, unnested, unnested_at, word_tokens


def year_from_name(name: Column | str) -> Column:
    """The first 192x or 193x in a name, or null."""
    return F.regexp_extract(as_column(name), YEAR, 1).try_cast("int")


def with_slice(df: DataFrame, value: Column, policy: str = "keep_null", fallback: int | str | None = None, column: str = "slice") -> DataFrame:
    """Add the slice column. Policies for a null slice: keep_null (in totals, in no slice), default and label (``fallback`` stands
    in, as a number or as text), drop."""
    if policy == "keep_null":
        return df.withColumn(column, value)
    if policy == "default":
        return df.withColumn(column, F.coalesce(value, F.lit(fallback)))
    if policy == "label":
        return df.withColumn(column, F.coalesce(value.cast("string"), F.lit(fallback)))
    if policy == "drop":
        return df.withColumn(column, value).where(F.col(column).isNotNull())
    raise ValueError(f"unknown policy {policy!r}")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where it has fewer partitions than twice their number: a Parquet row group is read by one task, so a
    small file would keep one core busy. Larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


def corpus(docs: DataFrame, stopwords: Sequence[str] = (), min_length: int = 1, letters_only: bool = False, lemmas: DataFrame | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, slice, tokens (kept), n_tokens, n_raw_tokens from docs (doc_id, slice, text).

    lemmas, if given, is (form, lemma): forms are replaced before filtering, and a document's order is kept.
    """
    raw = word_tokens("text") if pattern is None else word_tokens("text", pattern)
    rows = docs.select("doc_id", "slice", raw.alias("tokens")).withColumn("n_raw_tokens", F.size("tokens"))
    if lemmas is not None:
        rows = lemmatized(rows, lemmas)
    stop = F.lit(list(stopwords)) if stopwords else None

    def keeps(t: Column) -> Column:
        good = F.char_length(t) >= min_length
        if letters_only:
            good = good & t.rlike(r"^\p{L}+$")
        return good & ~F.array_contains(stop, t) if stop is not None else good

    kept = F.filter("tokens", keeps) if stopwords or min_length > 1 or letters_only else F.col("tokens")
    return rows.withColumn("tokens", kept).withColumn("n_tokens", F.size("tokens")).select("doc_id", "slice", "tokens", "n_tokens", "n_raw_tokens")


def lemmatized(rows: DataFrame, lemmas: DataFrame) -> DataFrame:
    """tokens with each form replaced by its lemma where there is one. Up to MOST_ROWS forms are a dictionary in every task, and no
    token travels. Of more forms, those a token list holds come back to it with their lemmas, by the list's hashes; equal lists
    (copies) are looked up together."""
    forms = lemmas.select(F.lower("form").alias("_t"), F.lower("lemma").alias("_l")).groupBy("_t").agg(F.min("_l").alias("_l")).where("_t is not null and _l is not null")
    few = forms.limit(MOST_ROWS + 1).collect()
    if len(few) <= MOST_ROWS:
        known = rows.sparkSession.sparkContext.broadcast({r["_t"]: r["_l"] for r in few})

        @F.arrow_udf("array<string>")
        def replaced(tokens: pa.Array) -> pa.Array:
            coded, table = tokens.flatten().dictionary_encode(), known.value
            words = pa.array([table.get(w, w) for w in coded.dictionary.to_pylist()], pa.string())
            lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
            return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), words.take(coded.indices))

        return rows.withColumn("tokens", replaced("tokens"))
    keyed = rows.withColumn("_a", F.xxhash64("tokens")).withColumn("_b", F.xxhash64(F.lit(1), "tokens"))
    found = unnested(keyed, F.array_distinct("tokens"), "_t", "_a", "_b").join(forms, "_t")
    back = found.groupBy("_a", "_b").agg(F.map_from_entries(F.collect_set(F.struct("_t", "_l"))).alias("_x"))

    @F.arrow_udf("array<string>")
    def looked_up(tokens: pa.Array, lemma: pa.Array) -> pa.Array:
        made = []
        for t, x in zip(tokens, lemma, strict=True):
            table = dict(x.as_py() or ())
            made.append([table.get(w, w) for w in t.as_py() or ()])
        return pa.array(made, pa.list_(pa.string()))

    return keyed.join(back, ["_a", "_b"], "left").withColumn("tokens", looked_up("tokens", "_x")).drop("_x", "_a", "_b")


def token_rows(corpus_df: DataFrame, *keys: str) -> DataFrame:
    """One row per token: doc_id, slice, pos (from 0), token."""
    return unnested_at(corpus_df, "tokens", "pos", "token", "doc_id", "slice", *keys)


def overview(corpus_df: DataFrame) -> DataFrame:
    """Per slice: documents, tokens, types and whole tokens per document."""
    sizes = corpus_df.groupBy("slice").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_raw_tokens").alias("n_raw_tokens"))
    types = token_rows(corpus_df).select("slice", "token").distinct().groupBy("slice").agg(F.count(F.lit(1)).alias("n_types"))
    per_doc = F.floor(F.col("n_tokens") / F.col("n_docs")).cast("long").alias("tokens_per_doc")
    return sizes.join(types, sizes.slice.eqNullSafe(types.slice), "left").select(sizes.slice, "n_docs", "n_tokens", "n_raw_tokens", F.coalesce("n_types", F.lit(0)).alias("n_types"), per_doc)


def encoded_tokens(tokens: Column | str) -> Column:
    """Tokens as one comma-joined string, for export."""
    return F.array_join(as_column(tokens), ",")


def decoded_tokens(text: Column | str) -> Column:
    return F.filter(F.split(as_column(text), ","), lambda t: t != "")


def distinct_texts(docs: DataFrame, *order: str) -> DataFrame:
    """The first document, by ``order``, of each text."""
    first = docs.groupBy("text").agg(F.min(F.struct(*order)).alias("_first"))
    return first.select("_first.*", "text")
