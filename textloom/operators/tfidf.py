"""TF-IDF as a long table, for tokens and for phrases in windows.

idf = ln((1 + N) / (1 + df)) + 1, rows scaled to length 1; the vocabulary is cut by document frequency, then by corpus frequency.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import space_tokens, unnested, word_tokens
from textloom.operators.frequency import top_k
from textloom.operators.windows import anchor_places


def weights(rows: DataFrame, key: str | Sequence[str], terms: str, min_df: int = 3, max_df: float = 0.9, max_features: int | None = 5000, sublinear: bool = False, decimals: int = 6) -> DataFrame:
    """(key, term, weight) of rows (key, terms array<string>); a key may have several columns. max_df is a share of the rows; documents without any term of the
    vocabulary have no rows."""
    keys = [key] if isinstance(key, str) else list(key)
    # dealt by key as whole arrays: counts and norms are then found where the arrays lie
    dealt = rows.select(*keys, terms).repartition(*keys)
    counts = unnested(dealt, terms, "term", *keys).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    size = rows.agg(F.count(F.lit(1)).alias("n_docs"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).crossJoin(size)
    vocabulary = df.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.col("n_docs")))
    if max_features is not None:
        vocabulary = vocabulary.orderBy(F.desc("total"), "term").limit(max_features)
    idf = (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf")
    small = F.broadcast if max_features is not None and max_features <= 20_000 else lambda x: x  # its size is then bounded
    tf = 1 + F.log("tf") if sublinear else F.col("tf").cast("double")
    raw = counts.join(small(vocabulary.select("term", idf)), "term").withColumn("w", tf * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))
    return raw.select(*keys, "term", F.round(F.col("w") / norm, decimals).alias("weight"))


UNIT_BYTES = 8_000_000
WINDOWS_AT_ONCE = 20_000


def phrase_scores(docs: DataFrame, anchor: str, window: int, stopwords: Sequence[str], sizes: Sequence[int] = (2, 3), k: int = 20, min_df: int = 3, max_df: float = 0.85) -> DataFrame:
    """slice, rank, term, score: the phrases with the highest mean weight over a slice's anchor windows (those without it count as
    0). docs: (slice, doc_id, text); phrases are the n-grams of a window's words that are no stop words.

    Windows overlap, so their phrases are never rows. Documents are dealt into units of about UNIT_BYTES; a unit sends each of its
    phrases once, with the number of its windows, gets back those of the vocabulary by their place among its sorted phrases, and
    sends each one's sum of weights by slice.
    """
    spark, stop = docs.sparkSession, F.lit(list(stopwords)) if stopwords else F.array().cast("array<string>")
    kept = docs.where("slice is not null").select("slice", "doc_id", "text")
    # the size of the job: bytes of text and windows by slice
    found = kept.groupBy("slice").agg(F.sum(F.octet_length("text")).alias("b"), F.sum(F.size(anchor_places(space_tokens("text"), anchor))).alias("n")).collect()
    slices, count = {r["slice"]: r["n"] or 0 for r in found}, sum(r["n"] or 0 for r in found)
    units = 1 + sum(r["b"] or 0 for r in found) // UNIT_BYTES
    dealt = kept.withColumn("unit", F.pmod(F.xxhash64("doc_id"), F.lit(units)).cast("int")).repartition("unit").withColumn("t", space_tokens("text"))
    words = F.transform("t", lambda x: F.filter(word_tokens(x), lambda w: ~F.array_contains(stop, w)))
    texts = dealt.select("unit", "slice", words.alias("words"), anchor_places(F.col("t"), anchor).alias("hits")).where(F.size("hits") > 0)
    kind = docs.schema["slice"].dataType.simpleString()

    def sent(table: pa.Table) -> pa.Table:
        unit = _Unit(table, window, sizes)
        n = np.zeros(unit.terms, np.int64)
        for _, terms, _ in unit.counted():
            n += np.bincount(terms, minlength=unit.terms)
        return pa.table({"unit": pa.array(np.full(unit.terms, table["unit"][0].as_py()), pa.int32()), "place": pa.array(np.arange(unit.terms), pa.int32()), "term": unit.strings(np.arange(unit.terms)), "n": n})

    def weighed(table: pa.Table, known: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"slice": table["slice"], "term": pa.array([], pa.string()), "w": pa.array([], pa.float64())})
        unit = _Unit(table, window, sizes)
        idf = np.zeros(unit.terms)
        idf[known["place"].to_numpy()] = np.log((1 + count) / (1 + known["df"].to_numpy())) + 1
        names = table["slice"].combine_chunks().dictionary_encode()
        codes, sums = names.indices.to_numpy()[unit.doc], np.zeros((len(names.dictionary), unit.terms))
        for windows, terms, tf in unit.counted():
            w = (1 + np.log(tf)) * idf[terms]
            at = windows - windows[0] if len(windows) else windows
            norm = np.sqrt(np.bincount(at, w * w))
            windows, terms, at, w = (x[w > 0] for x in (windows, terms, at, w))
            np.add.at(sums, (codes[windows], terms), np.round(w / norm[at], 12))
        part, term = np.nonzero(sums)
        return pa.table({"slice": names.dictionary.take(pa.array(part)), "term": unit.strings(term), "w": sums[part, term]})

    counts = texts.groupBy("unit").applyInArrow(sent, "unit int, place int, term string, n long")
    df = F.sum("n").over(Window.partitionBy("term"))
    known = counts.select("unit", "place", df.alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.lit(count)))
    sums = texts.groupBy("unit").cogroup(known.groupBy("unit")).applyInArrow(weighed, f"slice {kind}, term string, w double").groupBy("slice", "term").agg(F.sum("w").alias("w"))
    totals = spark.createDataFrame(list(slices.items()), f"slice {kind}, n long")
    scored = sums.join(F.broadcast(totals), "slice").select("slice", "term", F.round(F.col("w") / F.col("n"), 5).alias("score"))
    return top_k(scored, k, ["slice"], [F.desc("score"), "term"]).select("slice", "rank", "term", "score")


class _Unit:
    """The phrases of a unit's windows as numbers: their places in the order of sizes and then of their words, whatever the order of
    documents is. table: words (array of arrays, by parts between white space) and hits (places of anchors)."""

    def __init__(self, table: pa.Table, window: int, sizes: Sequence[int]):
        words, hits = table["words"].combine_chunks(), table["hits"].combine_chunks()
        parts, coded = words.flatten(), words.flatten().flatten().dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        self.words, codes = coded.dictionary.take(order), rank[coded.indices.to_numpy()]
        first = np.concatenate(([0], np.cumsum(pc.list_value_length(words).to_numpy())))  # a document's parts
        edges = np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy())))  # a part's words
        self.doc = np.repeat(np.arange(len(hits)), pc.list_value_length(hits).to_numpy())
        at = first[self.doc] + hits.flatten().to_numpy()
        self.start = edges[np.maximum(at - window, first[self.doc])]
        self.stop = edges[np.minimum(at + window + 1, first[self.doc + 1])]
        self.sizes, self.kinds, self.terms = sizes, [], 0
        for n in sizes:
            here = np.zeros(len(codes) + 1, np.int64)  # how many windows hold the phrase that begins at a place
            good = self.stop - self.start >= n
            np.add.at(here, self.start[good], 1)
            np.add.at(here, self.stop[good] - n + 1, -1)
            places = np.flatnonzero(np.cumsum(here)[:-1])
            keys = codes[places]
            for more in range(1, n):
                _, keys = np.unique(keys, return_inverse=True)  # pairs of numbers stay below 2^63
                keys = keys * len(self.words) + codes[places + more]
            _, one, inverse = np.unique(keys, return_index=True, return_inverse=True)
            number = np.full(len(codes), -1, np.int64)
            number[places] = inverse + self.terms
            self.kinds.append((n, self.terms, number, [codes[places[one] + j] for j in range(n)]))
            self.terms += len(one)

    def counted(self):
        """(windows, phrases, occurrences) for some windows at a time, in order of windows."""
        for i in range(0, len(self.start), WINDOWS_AT_ONCE):
            start, stop, keys = self.start[i : i + WINDOWS_AT_ONCE], self.stop[i : i + WINDOWS_AT_ONCE], []
            for n, _, number, _ in self.kinds:
                lengths = np.maximum(stop - start - n + 1, 0)
                of = np.repeat(np.arange(len(start)), lengths)
                places = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + start[of]
                keys.append(of * self.terms + number[places])
            if sum(map(len, keys)):
                found, tf = np.unique(np.concatenate(keys), return_counts=True)
                yield i + found // self.terms, found % self.terms, tf

    def strings(self, terms: np.ndarray) -> pa.Array:
        out, where = [], []
        for k, (_, begin, _, columns) in enumerate(self.kinds):
            end = self.kinds[k + 1][1] if k + 1 < len(self.kinds) else self.terms
            mine = np.flatnonzero((terms >= begin) & (terms < end))
            where.append(mine)
            out.append(pc.binary_join_element_wise(*[self.words.take(pa.array(c[terms[mine] - begin])) for c in columns], " "))
        back = np.empty(len(terms), np.int64)
        back[np.concatenate(where)] = np.arange(len(terms))
        return pa.concat_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out]).take(pa.array(back))
