"""n-grams of adjacent tokens; they never cross documents, and rates are per million tokens of the scope."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.stats import per_million, pmi
from textloom.operators.frequency import scoped, scoped_totals, top_k


TOKENS_AT_ONCE = 2_000_000


def ngram_rows(corpus_df: DataFrame, sizes: Sequence[int], seeds: Sequence[str] | None = None, slices: bool = True) -> DataFrame:
    """slice, n, ngram (space-joined), abs: n-grams counted within parts of a task's documents, to be added up; those that hold one of
    ``seeds``, if given. Tokens are numbers of a part's dictionary, so only its distinct n-grams become strings."""
    kind = corpus_df.schema["slice"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch["tokens"]), 0).to_numpy(zero_copy_only=False))
            first = 0
            while first < batch.num_rows:
                stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + TOKENS_AT_ONCE, "right")))
                for n in sizes:
                    yield _counted(batch.slice(first, stop - first), n, seeds)
                first = stop

    rows = corpus_df.select("slice" if slices else F.lit(None).cast(kind).alias("slice"), "tokens")
    return rows.mapInArrow(counted, f"slice {kind}, n int, ngram string, abs long")


def _counted(batch: pa.RecordBatch, n: int, seeds: Sequence[str] | None) -> pa.RecordBatch:
    lengths = pc.fill_null(pc.list_value_length(batch["tokens"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded, parts = batch["tokens"].flatten().dictionary_encode(), batch["slice"].dictionary_encode("encode")
    codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    part = np.repeat(parts.indices.to_numpy().astype(np.int64), lengths)
    places = np.flatnonzero(np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes)) >= n)
    if seeds is not None:
        wanted = set(seeds)
        seeded = np.array([not wanted.isdisjoint(w.split(" ")) for w in words.to_pylist()], bool)[codes]
        places = places[np.logical_or.reduce([seeded[places + j] for j in range(n)])]
    columns = [part[places], *[codes[places + j] for j in range(n)]]
    keys, bound = columns[0], max(1, len(parts.dictionary))
    exact = bound * max(1, len(words)) ** n < 2**62
    for c in columns[1:]:
        if not exact:
            keys = np.unique(keys, return_inverse=True)[1]  # so that a pair of numbers stays below 2^63
        keys = keys * len(words) + c
    if exact:
        keys, abs_ = np.unique(keys, return_counts=True)
        found = []
        for _ in range(n):
            keys, c = np.divmod(keys, max(1, len(words)))
            found.insert(0, c)
        found.insert(0, keys)
    else:
        _, one, abs_ = np.unique(keys, return_index=True, return_counts=True)
        found = [c[one] for c in columns]
    texts = [words.take(pa.array(c)) for c in found[1:]]
    grams = pc.binary_join_element_wise(*texts, " ") if n > 1 else texts[0]
    return pa.RecordBatch.from_arrays([parts.dictionary.take(pa.array(found[0])), pa.array(np.full(len(abs_), n, np.int32)), grams, pa.array(abs_.astype(np.int64))], ["slice", "n", "ngram", "abs"])


def ngram_counts(corpus_df: DataFrame, sizes: Sequence[int] = (2, 3), scopes: str = "both", seeds: Sequence[str] | None = None) -> DataFrame:
    """scope, ngram, n, abs, per_million, for every slice and all documents (see scoped); with ``seeds`` those that hold one."""
    # dealt by n-gram as they come: few repeat within a task, and slices and total are added up where they then lie
    rows = ngram_rows(corpus_df, sizes, seeds, scopes != "total").repartition("ngram")
    counts = scoped(rows, ["ngram", "n"], {"abs": F.sum("abs")}, scopes=scopes)
    return counts.join(F.broadcast(scoped_totals(corpus_df)), "scope").select("scope", "ngram", "n", "abs", per_million(F.col("abs"), F.col("total")).alias("per_million"))


def with_seeds(counts: DataFrame, seeds: dict[str, str]) -> DataFrame:
    """With has_seed, seed_terms and category: distinct seeds of the n-gram in its order, and their categories likewise."""
    terms, categories = F.lit(list(seeds)), F.create_map(*[F.lit(x) for pair in seeds.items() for x in pair])
    found = F.array_distinct(F.filter(F.split("ngram", " "), lambda t: F.array_contains(terms, t)))
    rows = counts.withColumn("_s", found)
    named = F.array_join(F.array_distinct(F.transform("_s", lambda t: F.element_at(categories, t))), ", ")
    return rows.withColumn("has_seed", F.size("_s") > 0).withColumn("seed_terms", F.array_join("_s", ", ")).withColumn("category", named).drop("_s")


def top_ngrams(counts: DataFrame, k: int = 30) -> DataFrame:
    return top_k(_leading(counts, k), k, ["scope", "n"], [F.desc("abs"), F.asc("ngram")])


def _leading(counts: DataFrame, k: int) -> DataFrame:
    """The k first rows of each scope and n within each task, found without a sort of all."""
    order = [("abs", "descending"), ("ngram", "ascending")]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, pa.Table] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for group in table.select(["scope", "n"]).group_by(["scope", "n"]).aggregate([]).to_pylist():
                key = (group["scope"], group["n"])
                same = pc.and_(pc.equal(table["scope"], key[0]), pc.equal(table["n"], key[1]))
                if key in held and held[key].num_rows == k:
                    same = pc.and_(same, pc.greater_equal(table["abs"], held[key]["abs"][-1]))
                rows = table.filter(same)
                if rows.num_rows:
                    rows = pa.concat_tables([held[key], rows]) if key in held else rows
                    held[key] = rows.take(pc.select_k_unstable(rows, k, order)).combine_chunks()
        for table in held.values():
            yield from table.to_batches()

    return counts.mapInArrow(best, counts.schema)


def bigram_pmi(corpus_df: DataFrame, least: int = 5, k: int = 20) -> DataFrame:
    """rank, word1, word2, pmi, abs: the adjacent pairs of ``least`` or more occurrences with the highest PMI."""
    counts = lambda n: ngram_rows(corpus_df, (n,), slices=False).repartition("ngram").groupBy("ngram").agg(F.sum("abs").alias("abs"))
    pairs = counts(2).where(F.col("abs") >= least).select(F.split("ngram", " ")[0].alias("word1"), F.split("ngram", " ")[1].alias("word2"), "abs")
    words = counts(1).select(F.col("ngram").alias("w"), F.col("abs").alias("n"))
    joined = pairs.join(words.select(F.col("w").alias("word1"), F.col("n").alias("n1")), "word1").join(words.select(F.col("w").alias("word2"), F.col("n").alias("n2")), "word2")
    scored = joined.crossJoin(corpus_df.agg(F.sum("n_tokens").alias("total"))).withColumn("pmi", F.round(pmi(F.col("abs"), F.col("total"), F.col("n1"), F.col("n2")), 4))
    best = scored.orderBy(F.desc("pmi"), F.desc("abs"), "word1", "word2").limit(k)
    return top_k(best.withColumn("_one", F.lit(1)), k, ["_one"], [F.desc("pmi"), F.desc("abs"), "word1", "word2"]).select("rank", "word1", "word2", "pmi", "abs")
