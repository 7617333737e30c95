"""Topics: NMF over sparse rows, LDA, shares by slice, dominant topics, comparison of models."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.joins import small
from textloom.functions.stats import jaccard
from textloom.functions.text import unnested
from textloom.operators.frequency import top_k

EPSILON = 1e-10
BLOCK = 4096


@dataclass
class Topics:
    terms: list[str]
    components: np.ndarray
    losses: list[float]
    shares: DataFrame


def nmf(weights: DataFrame, key: str = "doc_id", k: int = 7, rounds: int = 30, seed: int = 42, tolerance: float = 1e-4, inner: int = 5) -> Topics:
    """Factor (key, term, weight) into document shares and k topics by multiplicative updates (Lee and Seung 2001).

    The k x V factor is broadcast with each round's closure (V is the cut vocabulary); a round is one pass in which every document's
    row is fitted to the topics and its part of W'A and W'W is summed by k x V entries, so the driver sees k * V + k * k numbers.
    Deterministic for a seed. shares has (key, topic_0, ...), not scaled.
    """
    terms = [r["term"] for r in weights.select("term").distinct().orderBy("term").collect()]
    index, kind = {t: i for i, t in enumerate(terms)}, weights.schema[key].dataType.simpleString()
    rng = np.random.default_rng(seed)
    h = rng.random((k, len(terms))) + 0.1

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["x"]
            pairs, offsets = x.flatten(), pa.array(np.concatenate(([0], np.cumsum(pc.list_value_length(x).to_numpy()))), pa.int32())
            coded = pairs.field("term").dictionary_encode()
            numbers = np.array([index[t] for t in coded.dictionary.to_pylist()], np.int32)[coded.indices.to_numpy()]
            yield pa.RecordBatch.from_arrays([batch[key], pa.ListArray.from_arrays(offsets, pa.array(numbers)), pa.ListArray.from_arrays(offsets, pairs.field("weight"))], [key, "i", "v"])

    grouped = weights.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("x"))
    rows = grouped.mapInArrow(numbered, f"{key} {kind}, i array<int>, v array<double>").persist()

    def fitted(batch: pa.RecordBatch, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """Shares, the products with the topics they are fitted to, and each entry's row, term and value."""
        n, lengths = batch.num_rows, pc.list_value_length(batch["i"]).to_numpy()
        row, places, values = np.repeat(np.arange(n), lengths), batch["i"].flatten().to_numpy(), batch["v"].flatten().to_numpy()
        gram, w = h @ h.T, np.full((n, k), 1.0 / k)
        b = np.stack([np.bincount(row, h[t][places] * values, n) for t in range(k)], axis=1)
        for _ in range(4 * inner):
            w *= b / (w @ gram + EPSILON)
        return w, b, row, places, values

    losses: list[float] = []
    for _ in range(rounds):
        now = h

        def sums(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            numerator, inner_gram, loss = np.zeros_like(now), np.zeros((k, k)), 0.0
            for batch in batches:
                w, b, row, places, values = fitted(batch, now)
                for t in range(k):
                    numerator[t] += np.bincount(places, w[:, t][row] * values, now.shape[1])
                gram = w.T @ w
                inner_gram += gram
                loss += (gram * (now @ now.T)).sum() - 2 * (w * b).sum() + values @ values
            every = np.concatenate((numerator.ravel(), inner_gram.ravel(), [loss]))
            blocks = [every[i : i + BLOCK] for i in range(0, len(every), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.list_(pa.float64()))], ["block", "v"])

        def added(table: pa.Table) -> pa.Table:
            v = table["v"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(axis=0)
            return pa.table({"block": table["block"][:1], "v": pa.array([v], pa.list_(pa.float64()))})

        # summed block by block, so no partition's sums come to the driver
        parts = rows.select("i", "v").mapInArrow(sums, "block int, v array<double>")
        total = parts.groupBy("block").applyInArrow(added, "block int, v array<double>").collect()
        every = np.concatenate([r["v"] for r in sorted(total, key=lambda r: r["block"])])
        losses.append(float(every[-1]))
        if len(losses) > 1 and losses[-2] - losses[-1] < tolerance * losses[0]:
            break
        numerator, gram = every[: h.size].reshape(h.shape), every[h.size : -1].reshape(k, k)
        for _ in range(inner):
            h = h * numerator / (gram @ h + EPSILON)
    last = h

    def share_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = fitted(batch, last)[0]
            yield pa.RecordBatch.from_arrays([batch[key], *[pa.array(w[:, t]) for t in range(k)]], [key, *[f"topic_{t}" for t in range(k)]])

    shares = rows.mapInArrow(share_rows, f"{key} {kind}, " + ", ".join(f"topic_{t} double" for t in range(k)))
    return Topics(terms, h, losses, shares)


def topic_terms(topics: Topics, spark, n: int = 15, seeds: Sequence[str] = ()) -> DataFrame:
    """topic, rank, term, weight, is_seedterm: the n heaviest terms of each topic."""
    rows = []
    for t, row in enumerate(topics.components):
        order = sorted(range(len(row)), key=lambda i: (-row[i], topics.terms[i]))[:n]
        rows += [(t, r + 1, topics.terms[i], float(row[i]), topics.terms[i] in set(seeds)) for r, i in enumerate(order)]
    return spark.createDataFrame(rows, "topic int, rank int, term string, weight double, is_seedterm boolean")


def lda(corpus_df: DataFrame, k: int = 5, rounds: int = 30, vocabulary: int = 3000, min_df: int = 3, max_df: float = 0.9, n_terms: int = 15, seed: int = 42, optimizer: str = "online") -> tuple[DataFrame, DataFrame]:
    """(topic, rank, term, weight) and (doc_id, slice, topic_0, ...), by Spark's LDA on counted tokens."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizerModel
    from pyspark.ml.functions import vector_to_array

    rows = corpus_df.where("n_tokens > 0")
    # counted as rows: CountVectorizer's own fit keeps all tokens as objects, and which of equally frequent words it takes is left open
    most = max_df * rows.count() if max_df < 1 else float(2**53)
    once = F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("t"), F.lit(1).alias("d")))
    each = F.concat(F.transform("tokens", lambda t: F.struct(t.alias("t"), F.lit(0).alias("d"))), once)
    counts = unnested(rows, each, "x").groupBy("x.t").agg(F.count_if(F.col("x.d") == 0).alias("n"), F.sum("x.d").alias("df"))
    best = counts.where((F.col("df") >= min_df) & (F.col("df") <= most)).orderBy(F.desc("n"), "t").limit(vocabulary).collect()
    counter = CountVectorizerModel.from_vocabulary([r["t"] for r in best], inputCol="tokens", outputCol="features")
    counted = counter.transform(rows).select("doc_id", "slice", "features").persist()  # each round reads the counts, not the texts
    model = LDA(k=k, maxIter=rounds, seed=seed, optimizer=optimizer, featuresCol="features").fit(counted)
    counted.unpersist()
    words = F.lit(counter.vocabulary)
    described = model.describeTopics(n_terms).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("r", "x"))
    terms = described.select("topic", (F.col("r") + 1).alias("rank"), F.element_at(words, F.col("x.termIndices") + 1).alias("term"), F.col("x.termWeights").alias("weight"))
    shared = model.transform(counted).withColumn("d", vector_to_array("topicDistribution"))
    return terms, shared.select("doc_id", "slice", *[F.col("d")[t].alias(f"topic_{t}") for t in range(k)])


def inferred_topics(shares: DataFrame, k: int, least: float = 0.1) -> DataFrame:
    """doc_id, topic, p: the topics of each document with a share of ``least`` or more."""
    d = F.array(*[F.col(f"topic_{t}") for t in range(k)])
    return shares.select("doc_id", F.posexplode(d).alias("topic", "p")).where(F.col("p") >= least)


def normalised_shares(shares: DataFrame, k: int) -> DataFrame:
    """Shares divided by their row's sum; rows of zeros stay."""
    columns = [F.col(f"topic_{t}") for t in range(k)]
    total = sum(columns, F.lit(0.0))
    return shares.select(*[c for c in shares.columns if not c.startswith("topic_")], *[(c / F.when(total == 0, F.lit(1.0)).otherwise(total)).alias(f"topic_{t}") for t, c in enumerate(columns)])


def with_dominant(shares: DataFrame, k: int) -> DataFrame:
    """With dominant_topic: the first topic with the greatest share."""
    d = F.array(*[F.col(f"topic_{t}") for t in range(k)])
    return shares.withColumn("dominant_topic", (F.array_position(d, F.array_max(d)) - 1).cast("int"))


def slice_shares(shares: DataFrame, k: int, decimals: int = 4) -> DataFrame:
    """slice, topic, mean_share (of normalised rows), dominant_n_docs."""
    rows = with_dominant(normalised_shares(shares, k), k).where("slice is not null")
    grouped = rows.groupBy("slice").agg(*[F.struct(F.round(F.avg(f"topic_{t}"), decimals).alias("m"), F.count_if(F.col("dominant_topic") == t).alias("n")).alias(f"x{t}") for t in range(k)])
    return grouped.select("slice", F.posexplode(F.array(*[f"x{t}" for t in range(k)])).alias("topic", "x")).select("slice", "topic", F.col("x.m").alias("mean_share"), F.col("x.n").alias("dominant_n_docs"))


def compare_topics(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each topic of left (topic, terms array) the topic of right with the greatest Jaccard overlap, the first of ties: topic,
    best_topic, jaccard, overlap. Both sides are topics, a handful of rows."""
    pairs = left.select(F.col("topic"), F.col("terms").alias("a")).crossJoin(small(right.select(F.col("topic").alias("best_topic"), F.col("terms").alias("b")), 10_000))
    scored = pairs.withColumn("jaccard", jaccard(F.col("a"), F.col("b")))
    best = top_k(scored, 1, ["topic"], [F.desc("jaccard"), "best_topic"])
    return best.select("topic", "best_topic", "jaccard", F.array_join(F.array_sort(F.array_intersect("a", "b")), ", ").alias("overlap"))
