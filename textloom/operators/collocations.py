"""Window collocations of target terms with log-likelihood and PMI."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.stats import log_likelihood, pmi
from textloom.functions.text import unnested
from textloom.operators.frequency import scoped, scoped_totals, top_k


def around(tokens: Column, i: Column, window: int, inclusive: bool = False) -> Column:
    """Up to ``window`` tokens on both sides of index i (from 0), clipped at the ends, without index i unless inclusive."""
    first = F.greatest(i - F.lit(window), F.lit(0))
    left = F.slice(tokens, first + 1, i - first)
    if inclusive:
        return F.slice(tokens, first + 1, i - first + 1 + window)
    return F.concat(left, F.slice(tokens, i + 2, F.lit(window)))


def window_rows(corpus_df: DataFrame, targets: Sequence[str], window: int) -> DataFrame:
    """slice, target, collocate: one row for every token in every window of a target's occurrence, targets themselves left out.
    Windows are slices of the document's own array, so nothing is shuffled; only hits carry one."""
    wanted = F.lit(list(targets))
    hits = F.filter(F.transform("tokens", lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda x: F.array_contains(wanted, x["t"]))
    each = unnested(corpus_df, hits, "h", "slice", "tokens")
    return each.select("slice", F.col("h.t").alias("target"), F.explode_outer(around(F.col("tokens"), F.col("h.i"), window)).alias("collocate")).where("collocate <> target")


def collocations(corpus_df: DataFrame, targets: Sequence[str], window: int = 5, least: int = 3) -> DataFrame:
    """scope, target, collocate, cofreq, freq_target, freq_collocate, n_total, ll, pmi for pairs of ``least`` or more.

    cofreq counts occurrences over all windows, so tokens in overlapping windows count in each; pairs whose table would have a
    negative cell are left out.
    """
    co = scoped(window_rows(corpus_df, targets, window), ["target", "collocate"], {"cofreq": F.count(F.lit(1))}).where(F.col("cofreq") >= least)
    single = scoped(unnested(corpus_df, "tokens", "w", "slice"), ["w"], {"n": F.count(F.lit(1))})
    totals = scoped_totals(corpus_df).withColumnRenamed("total", "n_total")
    targeted = corpus_df.select("slice", F.filter("tokens", lambda t: t.isin(list(targets))).alias("t"))
    of_target = scoped(unnested(targeted, "t", "target", "slice"), ["target"], {"freq_target": F.count(F.lit(1))})
    of_other = single.select("scope", F.col("w").alias("collocate"), F.col("n").alias("freq_collocate"))
    joined = co.join(of_other, ["scope", "collocate"]).join(F.broadcast(of_target), ["scope", "target"]).join(F.broadcast(totals), "scope")
    o11, o12, o21 = F.col("cofreq"), F.col("freq_target") - F.col("cofreq"), F.col("freq_collocate") - F.col("cofreq")
    o22 = F.col("n_total") - F.col("freq_target") - F.col("freq_collocate") + F.col("cofreq")
    valid = joined.where((o12 >= 0) & (o21 >= 0) & (o22 >= 0))
    return valid.select(
        "scope", "target", "collocate", "cofreq", "freq_target", "freq_collocate", "n_total",
        F.round(log_likelihood(o11, o12, o21, o22), 4).alias("ll"), F.round(pmi(o11, F.col("n_total"), F.col("freq_target"), F.col("freq_collocate")), 4).alias("pmi"),
    )


def top_collocations(scored: DataFrame, measure: str = "ll", k: int = 20, least: int = 0) -> DataFrame:
    """The k best collocates of each scope and target by ll or pmi; for pmi a least cofreq of 5 is usual."""
    return top_k(scored.where(F.col("cofreq") >= least), k, ["scope", "target"], [F.desc(measure), F.asc("collocate")])


def compare_slices(scored: DataFrame, target: str, slices: Sequence, measure: str = "ll", k: int = 20) -> DataFrame:
    """collocate and its score in each slice, for collocates found in two slices or more, by falling sum of scores."""
    wide = scored.where((F.col("target") == target) & F.col("scope").isin([str(s) for s in slices])).groupBy("collocate").pivot("scope", [str(s) for s in slices]).agg(F.first(measure))
    named = wide.select("collocate", *[F.col(f"`{s}`").alias(f"y{s}") for s in slices]).na.drop(thresh=2, subset=[f"y{s}" for s in slices])
    total = sum((F.coalesce(F.col(f"y{s}"), F.lit(0.0)) for s in slices), F.lit(0.0))
    return named.withColumn("total", F.round(total, 3)).orderBy(F.desc("total"), "collocate").limit(k)


def tagged_collocations(tagged: DataFrame, prefix: str, window: int = 5, content: Sequence[str] = ("NOUN", "VERB", "ADJ", "PROPN"), k: int = 50) -> DataFrame:
    """rank, collocate, pos_tag, n, share around lemmas that begin with ``prefix`` (ſ read as s).

    tagged: doc_id, tokens array<struct<text, lemma, pos, is_stop>>. Windows count all tokens; collocates are content words (a null
    tag passes) that are no stop words and don't begin with the prefix. share is of all collocates found, before the cut; pos_tag is
    the last seen in order of document and place.
    """
    word = lambda x: F.translate(F.lower(x["lemma"]), "ſ", "s")
    rows = F.transform("tokens", lambda t: F.struct(word(t).alias("w"), t["pos"].alias("p"), t["is_stop"].alias("s")))
    kind = tagged.schema["doc_id"].dataType.simpleString()

    def around_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each token near a hit once, with the number of hits it is near to: the work grows with the tokens, not with tokens and hits."""
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch["x"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, ends = batch["x"].flatten(), np.cumsum(lengths)
            hit = pc.fill_null(pc.starts_with(flat.field("w"), prefix), False).to_numpy(zero_copy_only=False).astype(np.int64)
            doc, at, before = np.repeat(np.arange(len(lengths)), lengths), np.arange(len(hit)), np.concatenate(([0], np.cumsum(hit)))
            begin, end = (ends - lengths)[doc], ends[doc]
            n = before[np.minimum(at + window + 1, end)] - before[np.maximum(at - window, begin)] - hit
            near = pa.array(np.flatnonzero(n))
            columns = [batch["doc_id"].take(pa.array(doc[n > 0])), pa.array((at - begin)[n > 0].astype(np.int32)), *[flat.field(f).take(near) for f in "wps"], pa.array(n[n > 0])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "i", "w", "p", "s", "n"])

    found = tagged.select("doc_id", rows.alias("x")).mapInArrow(around_hits, f"doc_id {kind}, i int, w string, p string, s boolean, n long")
    near = found.select("doc_id", "i", F.regexp_replace("w", "[^a-zäöüß]", "").alias("collocate"), "p", "s", "n")
    kept = near.where((F.col("p").isNull() | F.col("p").isin(list(content))) & ~F.coalesce("s", F.lit(False)) & (F.col("collocate") != "") & ~F.startswith("collocate", F.lit(prefix)))
    counts = kept.groupBy("collocate").agg(F.sum("n").alias("n"), F.max_by("p", F.struct("doc_id", "i")).alias("pos_tag"))
    # a step that no column is pruned through: the counts and their sum then read the same exchange, so texts are tagged once
    counts = counts.mapInArrow(lambda batches: batches, counts.schema)
    best = counts.crossJoin(counts.agg(F.sum("n").alias("all"))).orderBy(F.desc("n"), "collocate").limit(k).withColumn("_one", F.lit(1))
    return top_k(best, k, ["_one"], [F.desc("n"), "collocate"]).select("rank", "collocate", "pos_tag", "n", F.round(F.col("n") / F.col("all") * 100, 2).alias("share"))


def word_forms(tagged: DataFrame, prefix: str, k: int = 20) -> DataFrame:
    """rank, form, n, n_docs: the written forms of lemmas that begin with ``prefix``."""
    hits = unnested(tagged, "tokens", "t", "doc_id").where(F.startswith(F.translate(F.lower("t.lemma"), "ſ", "s"), F.lit(prefix)))
    counts = hits.groupBy(F.col("t.text").alias("form")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))
    best = counts.orderBy(F.desc("n"), "form").limit(k).withColumn("_one", F.lit(1))
    return top_k(best, k, ["_one"], [F.desc("n"), "form"]).select("rank", "form", "n", "n_docs")
