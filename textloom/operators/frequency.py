"""Term frequencies, grids, pattern frequencies, coverage and document matrices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.joins import small
from textloom.functions.stats import change_label, per_million
from textloom.functions.text import unnested, unnested_at, word_tokens

TOTAL = "gesamt"


def top_k(df: DataFrame, k: int, by: Sequence[str], order: Sequence, rank: str = "rank") -> DataFrame:
    """The k first rows of each group under a total order, with their rank."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)


def totals(corpus_df: DataFrame, *by: str) -> DataFrame:
    return corpus_df.groupBy(*by).agg(F.sum("n_tokens").alias("total"))


def summed(counts: DataFrame, by: str, count: str = "abs", name: str = "total") -> DataFrame:
    """Totals from counts of all terms: the shuffled counts are read again instead of the texts."""
    return counts.groupBy(by).agg(F.sum(count).alias(name))


def frequencies(corpus_df: DataFrame) -> DataFrame:
    """token, abs, per_million over all documents."""
    counts = unnested(corpus_df, "tokens", "token").groupBy("token").agg(F.count(F.lit(1)).alias("abs"))
    return counts.crossJoin(counts.agg(F.sum("abs").alias("total"))).select("token", "abs", per_million(F.col("abs"), F.col("total")).alias("per_million"))


def frequencies_by_slice(corpus_df: DataFrame) -> DataFrame:
    """slice, token, abs, per_million of the slice's tokens; documents without slice are left out."""
    kept = corpus_df.where("slice is not null")
    counts = unnested(kept, "tokens", "token", "slice").groupBy("slice", "token").agg(F.count(F.lit(1)).alias("abs"))
    return counts.join(summed(counts, "slice"), "slice").select("slice", "token", "abs", per_million(F.col("abs"), F.col("total")).alias("per_million"))


def scoped(rows: DataFrame, keys: Sequence[str], measures: Mapping[str, object], slice_column: str = "slice", scopes: str = "both") -> DataFrame:
    """Measures by keys for every slice and for all documents (scope gesamt, which includes the null slice). Measures are counts or
    sums: rows are counted once by slice, and the total adds these up. scopes: both, slices or total."""
    if scopes == "total":
        return rows.groupBy(*keys).agg(*[m.alias(n) for n, m in measures.items()]).select(F.lit(TOTAL).alias("scope"), *keys, *measures)
    by_slice = rows.groupBy(slice_column, *keys).agg(*[m.alias(n) for n, m in measures.items()])
    # a filter on the slice would be pushed below the aggregation, and total and slices would no longer share it
    slices = unnested(by_slice, F.array(F.col(slice_column).cast("string")), "scope", *keys, *measures).select("scope", *keys, *measures)
    if scopes == "slices":
        return slices
    total = by_slice.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in measures]).select(F.lit(TOTAL).alias("scope"), *keys, *measures)
    return slices.unionByName(total)


def scoped_totals(corpus_df: DataFrame) -> DataFrame:
    return scoped(corpus_df, [], {"total": F.sum("n_tokens")})


def scoped_frequencies(corpus_df: DataFrame) -> DataFrame:
    """scope, token, abs, per_million."""
    counts = scoped(unnested(corpus_df, "tokens", "token", "slice"), ["token"], {"abs": F.count(F.lit(1))})
    return counts.join(summed(counts, "scope"), "scope").select("scope", "token", "abs", per_million(F.col("abs"), F.col("total")).alias("per_million"))


def seed_grid(corpus_df: DataFrame, seeds: DataFrame, slices: Sequence) -> DataFrame:
    """slice, term, category, abs, per_million for every seed term in every slice, 0 where absent. seeds: (term, category)."""
    spark = corpus_df.sparkSession
    grid = seeds.crossJoin(spark.createDataFrame([(s,) for s in slices], corpus_df.select("slice").schema))
    terms = [r["term"] for r in seeds.select("term").distinct().collect()]  # the caller's list
    # one pass: of each document its token count, under no term, and its seeds
    hits = F.transform(F.filter("tokens", lambda t: t.isin(terms)), lambda t: F.struct(t.alias("token"), F.lit(1).cast("long").alias("n")))
    size = F.array(F.struct(F.lit(None).cast("string").alias("token"), F.col("n_tokens").cast("long").alias("n")))
    rows = unnested(corpus_df.where("slice is not null"), F.concat(size, hits), "x", "slice").groupBy("slice", F.col("x.token").alias("token")).agg(F.sum("x.n").alias("abs"))
    total = F.max(F.when(F.col("token").isNull(), F.col("abs"))).over(Window.partitionBy("slice"))
    found = rows.withColumn("total", total).where("token is not null").select("slice", "token", "abs", per_million(F.col("abs"), F.col("total")).alias("per_million"))
    joined = grid.join(found.withColumnRenamed("token", "term"), ["term", "slice"], "left")
    return joined.select("slice", "term", "category", F.coalesce("abs", F.lit(0)).alias("abs"), F.coalesce("per_million", F.lit(0.0)).alias("per_million"))


def pivoted(df: DataFrame, row: Sequence[str], column: str, values: Sequence, measure: str, fill=0, prefix: str = "y") -> DataFrame:
    """Sums of ``measure`` by row, a column for each given value, ``fill`` where there is none."""
    wide = df.groupBy(*row).pivot(column, list(values)).agg(F.sum(measure))
    return wide.select(*row, *[F.coalesce(F.col(f"`{v}`"), F.lit(fill)).alias(f"{prefix}{v}") for v in values])


def pattern_frequencies(docs: DataFrame, patterns: Sequence[tuple[str, str, str]], forms: int = 5) -> DataFrame:
    """slice, term, category, abs, per_million, n_tokens, n_docs, top_forms for patterns (term, category, regex) on raw text.

    All patterns are literals of one projection, so texts are read once; n_tokens counts the slice's word tokens.
    """
    found = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(c).alias("category"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("hits")) for t, c, p in patterns])
    rows = docs.where("slice is not null").select("doc_id", "slice", F.explode(found).alias("x")).select("doc_id", "slice", "x.*").where(F.size("hits") > 0)
    totals_ = docs.where("slice is not null").groupBy("slice").agg(F.sum(F.size(word_tokens("text"))).alias("n_tokens"))
    spark = docs.sparkSession
    grid = totals_.crossJoin(F.broadcast(spark.createDataFrame([(t, c) for t, c, _ in patterns], "term string, category string")))
    counts = rows.groupBy("slice", "term").agg(F.sum(F.size("hits")).alias("abs"), F.count(F.lit(1)).alias("n_docs"))
    spelled = rows.select("slice", "term", F.explode("hits").alias("form")).groupBy("slice", "term", F.lower("form").alias("form")).agg(F.count(F.lit(1)).alias("n"))
    best = top_k(spelled, forms, ["slice", "term"], [F.desc("n"), F.asc("form")])
    listed = best.groupBy("slice", "term").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat("form", F.lit("("), "n", F.lit(")")).alias("f")))).alias("f"))
    joined = grid.join(counts, ["slice", "term"], "left").join(listed, ["slice", "term"], "left")
    n = F.coalesce("abs", F.lit(0))
    return joined.select("slice", "term", "category", n.alias("abs"), per_million(n, F.col("n_tokens"), 1).alias("per_million"), "n_tokens", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce(F.array_join(F.transform("f", lambda x: x["f"]), ", "), F.lit("")).alias("top_forms"))


def coverage(docs: DataFrame, patterns: Sequence[tuple[str, str]], slices: Sequence) -> DataFrame:
    """term and, for each slice, abs_<slice> and docs_<slice> (documents with a hit / documents), for patterns (term, regex)."""
    counts = [F.regexp_count("text", F.lit(p)).alias(f"c{k}") for k, (_, p) in enumerate(patterns)]
    per_doc = docs.where(F.col("slice").isin(list(slices))).select("slice", *counts)
    sums = per_doc.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), *[x for k in range(len(patterns)) for x in (F.sum(f"c{k}").alias(f"s{k}"), F.count_if(F.col(f"c{k}") > 0).alias(f"d{k}"))])
    long = sums.select("slice", "n", F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"s{k}").alias("s"), F.col(f"d{k}").alias("d")) for k, (t, _) in enumerate(patterns)])).alias("x"))
    wide = long.select("slice", "x.term", "x.s", F.concat_ws("/", "x.d", "n").alias("d")).groupBy("term").pivot("slice", list(slices)).agg(F.first("s").alias("abs"), F.first("d").alias("docs"))
    return wide.select("term", *[c for s in slices for c in (F.coalesce(F.col(f"`{s}_abs`"), F.lit(0)).alias(f"abs_{s}"), F.coalesce(F.col(f"`{s}_docs`"), F.lit("0/0")).alias(f"docs_{s}"))])


def document_matrix(docs: DataFrame, terms: Sequence[str], pattern: str = r"[a-zäöüß]+") -> DataFrame:
    """doc_id, slice, n_words and for each term its count and rate per million, in one projection; documents without slice go."""
    rows = docs.where("slice is not null").select("doc_id", "slice", word_tokens("text", pattern).alias("w"))
    n = F.size("w")
    columns = []
    for t in terms:
        c = F.size(F.array_compact(F.transform("w", _equal_or_null(t))))
        columns += [c.alias(t), per_million(c, n).alias(f"{t}_ppm")]
    return rows.select("doc_id", "slice", n.alias("n_words"), *columns)


def _equal_or_null(term: str):
    return lambda x: F.when(x == term, x)


def compare_methods(by_pattern: DataFrame, by_term: DataFrame, mapping: DataFrame) -> DataFrame:
    """slice, stem, n_pattern, n_terms, change: pattern counts (slice, term, abs) against summed term counts (slice, token, abs)
    through mapping (stem, token)."""
    summed = by_term.join(small(mapping), "token").groupBy("slice", "stem").agg(F.sum("abs").alias("n_terms"))
    stems = mapping.select("stem").distinct()
    left = by_pattern.select("slice", F.col("term").alias("stem"), F.col("abs").alias("n_pattern")).join(small(stems), "stem", "left_semi")
    joined = left.join(summed, ["slice", "stem"], "left").withColumn("n_terms", F.coalesce("n_terms", F.lit(0)))
    return joined.select("slice", "stem", "n_pattern", "n_terms", change_label(F.col("n_terms"), F.col("n_pattern")).alias("change"))


def most_common(corpus_df: DataFrame, k: int = 20) -> DataFrame:
    """rank, token, abs of the k most frequent tokens, ties in order of first occurrence (by doc_id, then place)."""
    places = unnested_at(corpus_df, "tokens", "pos", "token", "doc_id")
    counts = places.groupBy("token").agg(F.count(F.lit(1)).alias("abs"), F.min(F.struct("doc_id", "pos")).alias("first"))
    order = [F.desc("abs"), F.asc("first")]
    best = counts.orderBy(*order).limit(k).withColumn("_one", F.lit(1))
    return top_k(best, k, ["_one"], order).select("rank", "token", "abs")
