"""N-gram Jaccard join with Bayesian pruning (after BayesLSH, Satuluri and Parthasarathy 2012).

Equal texts are one class from the start. Each distinct text gets ``n_hashes`` MinHash values (low 16 bits kept) over its
five-word shingles. Texts that agree on all values of a band are candidates; values are then compared ``step`` at a time and a
pair is dropped once P(similarity >= threshold | matches so far), under a uniform prior, falls below ``tolerance``. What is left
is verified on the shingles themselves, no hashes.

With 40 bands of 5, a pair at similarity 0.8 shares no band with probability 1e-7. The first 64 values are compared inside the
band buckets and give groups of texts that are connected; each text then travels once to its group (large groups are dealt
into pairs of blocks), where the comparison goes on and survivors are verified. No pair is ever a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, binomial_tail_below, bucket_units, components, from_spot, group_bounds, group_pairs, join_hot, map_whole_groups, materialize, own_pairs, spot
from .shingles import WordHasher, exact_sets, mix64, text_groups, words_of

N_HASHES, BAND = 200, 5
FIRST = 64
#: Buckets of the bit table that says which texts may be in a group.
BITS = 1 << 20


def hash_seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n odd multipliers and n masks."""
    with np.errstate(over="ignore"):
        x = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[n:] >> np.uint64(32)).astype(np.uint32)


def minhashes(hashes: np.ndarray, bounds: np.ndarray, n: int = N_HASHES) -> np.ndarray:
    """uint16[texts, n] of texts that all have shingles."""
    multipliers, masks = hash_seeds(n)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, n), dtype=np.uint16)
    t = np.empty_like(low)
    for k in range(n):
        np.bitwise_xor(low, masks[k], out=t)
        np.multiply(t, multipliers[k], out=t)
        out[:, k] = np.minimum.reduceat(t, bounds[:-1]).astype(np.uint16)
    return out


def least_matches(threshold: float, tolerance: float, n: int) -> int:
    """The fewest matches among n values that keep a pair."""
    return next(m for m in range(n + 1) if binomial_tail_below(n, m, threshold) >= tolerance)


def surviving(sig: np.ndarray, i: np.ndarray, j: np.ndarray, steps: list[tuple[int, int, int]]) -> np.ndarray:
    """Which pairs pass every step (from, to, least matches of the first ``to`` values)."""
    alive, matches = np.arange(len(i)), np.zeros(len(i), dtype=np.int32)
    for lo, hi, least in steps:
        matches = matches + (sig[i[alive], lo:hi] == sig[j[alive], lo:hi]).sum(1, dtype=np.int32)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
    return alive


def _signatures(frames, n: int, n_hashes: int):
    hasher = WordHasher()
    for pdf in frames:
        texts, sigs = pdf["text"].tolist(), []
        for lo, hi in text_groups(texts):
            h, bounds = words_of(texts[lo:hi], hasher, n)
            some = np.flatnonzero(np.diff(bounds))
            own: list[bytes | None] = [None] * (hi - lo)
            if len(some):
                for k, row in zip(some, minhashes(h, np.r_[bounds[some], bounds[-1]], n_hashes), strict=True):
                    own[k] = row.tobytes()
            sigs += own
        yield pd.DataFrame({"digest": pdf["digest"], "known": pdf["known"], "id": pdf["id"], "sig": sigs})


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted, distinct arrays."""
    n = len(sets)
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = np.cumsum(count > 1) - 1
    keep = (count > 1)[inverse]
    column, owner = shared[inverse[keep]], owner[keep]
    total = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((n, min(width, int(column[b - 1]) - lo + 1) if b > a else 1), dtype=np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        total += part @ part.T
    return total


def near_texts(docs: DataFrame, threshold: float = 0.8, n: int = 5, tolerance: float = 1e-6, block: int = 300) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id, text_id, n_copies, n_links, n_text_links.

    text_id is the least doc_id with an equal text; n_copies counts the rows of that text. n_links counts the other rows whose
    text is equal or has a Jaccard similarity of ``threshold`` or more on n-word shingles, n_text_links the other distinct such
    texts. class_id is the least doc_id reachable by links. A null text counts as empty; a text without words has no links but
    to its copies. Null ids take part and sort first; repeated rows each come back. Other columns are not touched.
    """
    own = docs.select(spot().alias("first"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    flat = own.select("digest", "first.known", "first.id", "text")
    signed = materialize(flat.mapInPandas(lambda frames: _signatures(frames, n, N_HASHES), "digest binary, known boolean, id long, sig binary"))
    texts = materialize(
        signed.groupBy("digest").agg(F.min(F.struct("known", "id")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig")).withColumn("rid", F.monotonically_increasing_id())
    )
    bands = texts.where("sig is not null").select(
        "rid", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(N_HASHES // BAND - 1)), lambda i: F.substring("sig", i * 2 * BAND + 1, F.lit(2 * BAND)))).alias("band", "part")
    )
    units = bucket_units(bands.select("rid", F.xxhash64("band", "part").alias("band")), "band", "rid", 500)
    early = [(lo, hi, least_matches(threshold, tolerance, hi)) for lo, hi in ((0, 16), (16, 32), (32, FIRST))]
    late = [(lo, hi, least_matches(threshold, tolerance, hi)) for lo, hi in ((0, FIRST), (FIRST, 128), (128, N_HASHES))]

    def compare(pdf: pd.DataFrame):
        bounds, rid, half = group_bounds(pdf["unit"].to_numpy()), pdf["rid"].to_numpy(), pdf["half"].to_numpy()
        sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint16).reshape(len(pdf), FIRST)
        forest = Forest(len(pdf))
        for i, j in group_pairs(bounds):
            own = own_pairs(half, i, j)
            i, j = i[own], j[own]
            kept = surviving(sig, i, j, early)
            for x, y in zip(i[kept].tolist(), j[kept].tolist(), strict=True):
                forest.join(x, y)
        yield forest.stars(rid)

    short = units.join(texts.select("rid", F.substring("sig", 1, 2 * FIRST).alias("sig")), "rid").select("unit", "half", "rid", "sig")
    groups = materialize(components(map_whole_groups(short, "unit", compare, "a long, b long")))

    full = materialize(groups.join(texts, groups.node == texts.rid).select("rid", "root", "digest", "first", "copies", "sig"))
    placed = bucket_units(full.select("rid", "root", "copies", "sig"), "root", "rid", block)
    bit = F.pmod(F.xxhash64("digest"), F.lit(BITS))  # a bit table of bounded size keeps most texts that no group has out of the shuffle
    some = full.select(bit.alias("_bit")).distinct()
    wanted = full.select("rid", "first", "digest").join(own.withColumn("_bit", bit).join(F.broadcast(some), "_bit", "left_semi"), ["first", "digest"]).select("rid", "text")
    sent = placed.join(wanted.dropDuplicates(["rid"]), "rid").select("unit", "half", "rid", "copies", "sig", "text")

    def verify(pdf: pd.DataFrame):
        pdf = pdf.drop_duplicates(["unit", "rid"]).reset_index(drop=True)
        bounds, rid, copies = group_bounds(pdf["unit"].to_numpy()), pdf["rid"].to_numpy(), pdf["copies"].to_numpy()
        half = pdf["half"].to_numpy()
        sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint16).reshape(len(pdf), N_HASHES)
        sets = exact_sets(pdf["text"].tolist(), n)
        size = np.array([len(s) for s in sets], dtype=np.int64)
        a, b, na, nb = [], [], [], []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            i, j = np.triu_indices(int(hi - lo), 1)
            i, j = i + lo, j + lo
            fits = own_pairs(half, i, j) & (np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]))
            i, j = i[fits], j[fits]
            kept = surviving(sig, i, j, late)
            i, j = i[kept], j[kept]
            if not len(i):
                continue
            if hi - lo <= 3:
                both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j, strict=True)])
            else:
                both = overlaps(sets[lo:hi])[i - lo, j - lo]
            linked = both >= threshold * (size[i] + size[j] - both) - 1e-9
            if not linked.any():
                continue
            a.append(rid[i[linked]])
            b.append(rid[j[linked]])
            na.append(copies[i[linked]])
            nb.append(copies[j[linked]])
        yield _links(a, b, na, nb)

    verified = materialize(map_whole_groups(sent, "unit", verify, "a long, b long, links long, texts long, pair long", 64))
    counted = verified.where("pair is null").groupBy(F.col("a").alias("rid")).agg(F.sum("links").alias("links"), F.sum("texts").alias("near"))
    roots = components(verified.where("pair is not null").select("a", "b"))
    classes = texts.select("rid", "digest", "first", "copies").join(roots.withColumnRenamed("node", "rid"), "rid", "left").join(counted, "rid", "left")
    least = classes.where("root is not null").groupBy("root").agg(F.min("first").alias("class"))
    named = classes.join(least, "root", "left").select("digest", "first", "copies", F.coalesce("class", "first").alias("class"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("near", F.lit(0)).alias("near"))
    found = join_hot(signed.select(F.struct("known", "id").alias("key"), "digest"), materialize(named), "digest", "copies")
    return found.select(
        from_spot(F.col("key")).alias("doc_id"),
        from_spot(F.col("class")).alias("class_id"),
        from_spot(F.col("first")).alias("text_id"),
        F.col("copies").alias("n_copies"),
        (F.col("links") + F.col("copies") - 1).alias("n_links"),
        F.col("near").alias("n_text_links"),
    )


def _links(a: list, b: list, na: list, nb: list) -> pd.DataFrame:
    """Counts per text of the units seen (pair null), and a spanning forest of the links (pair 1)."""
    columns = {"a": [], "b": [], "links": [], "texts": [], "pair": []}
    if a:
        a, b, na, nb = map(np.concatenate, (a, b, na, nb))
        pairs = pd.DataFrame({"a": a, "b": b, "na": na, "nb": nb})
        ends = pd.DataFrame({"a": np.r_[pairs.a, pairs.b], "links": np.r_[pairs.nb, pairs.na]}).groupby("a")["links"].agg(["sum", "count"]).reset_index()
        node, inverse = np.unique(np.r_[a, b], return_inverse=True)
        forest = Forest(len(node))
        for x, y in zip(inverse[: len(a)].tolist(), inverse[len(a) :].tolist(), strict=True):
            forest.join(x, y)
        root = np.array([forest.find(x) for x in range(len(node))], dtype=np.int64)
        other = np.flatnonzero(root != np.arange(len(node)))
        columns = {
            "a": np.r_[ends["a"], node[other]],
            "b": np.r_[np.zeros(len(ends), dtype=np.int64), node[root[other]]],
            "links": np.r_[ends["sum"], np.zeros(len(other), dtype=np.int64)],
            "texts": np.r_[ends["count"], np.zeros(len(other), dtype=np.int64)],
            "pair": [None] * len(ends) + [1] * len(other),
        }
    return pd.DataFrame(columns).astype({"a": "int64", "b": "int64", "links": "int64", "texts": "int64", "pair": "Int64"})


def one_per_class(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` less all but one of each class of near texts: the row of the least doc_id stays (of repeated rows with
    that id and an equal text, one)."""
    found = near_texts(docs, **parameters).where("doc_id <=> class_id and doc_id <=> text_id").select(spot().alias("_tl_key")).distinct()
    kept = docs.withColumn("_tl_key", spot()).join(found, "_tl_key", "left_semi").withColumn("_tl_digest", F.md5(F.col("text").cast("binary")))
    return kept.dropDuplicates(["_tl_key", "_tl_digest"]).select(*[F.col(f"`{c}`") for c in docs.columns])
