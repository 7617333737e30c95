"""Nearest neighbours by inner product with an adaptive dimension scan (after ADSampling, Gao and Long 2023, and PDX, 2025).

Inner product becomes Euclidean distance by one more dimension (sqrt(M^2 - |x|^2), M the largest norm; 0 for queries). Vectors are
rotated at random, so any first d of D dimensions sample the distance. An inverted file deals them to the lists of the nearest
centroid, fitted on a bounded sample; long lists are cut into blocks. A query scans its probed lists in blocks of dimensions and
gives a candidate up once sqrt(D / d) times the partial distance exceeds (1 + e / sqrt(d)) times its radius, which shrinks to the
k-th best distance found in the list so far. Scores of what is left are inner products of the original vectors in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_whole_groups, materialize

STEP, EPSILON = 16, 2.1


def rotation(size: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(vec_id, v): rows with an id whose vector is neither null, empty, zero nor holds null or non-finite components."""
    v = F.col(column).cast("array<double>")
    good = F.aggregate(v, F.lit(True), lambda a, x: a & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.aggregate(v, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))) > 0)
    return vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(good, F.lit(False)))


def kmeans(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * sample @ centres.T, axis=1)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres).astype(np.float32)
    return centres


def adaptive_scan(queries: np.ndarray, vectors: np.ndarray, radius: np.ndarray, k: int = 20, turn: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(query rows, vector rows) of rotated pairs that are not given up on within each query's squared radius.

    Vectors are looked at ``turn`` at a time; after each turn a query's radius shrinks to the distance of its (k + 1)-th nearest
    vector of this call so far (one may be the query itself), if that is less.
    """
    size = vectors.shape[1]
    radius = radius.astype(np.float32)
    best = np.full((len(queries), k + 1), np.inf, dtype=np.float32)
    found_q, found_v = [], []

    def bound(d: int) -> np.ndarray:
        return radius * np.float32((1 + EPSILON / math.sqrt(d)) ** 2 * d / size if d < size else 1 + 1e-4)

    d = min(STEP, size)
    a = queries[:, :d]
    head = (a * a).sum(1)[:, None]
    for start in range(0, len(vectors), turn):
        b = vectors[start : start + turn, :d]
        partial = head + (b * b).sum(1)[None] - 2 * a @ b.T
        q, v = np.nonzero(partial <= bound(d)[:, None])
        partial, v = partial[q, v], v + start
        for lo in range(d, size, STEP):
            hi = min(size, lo + STEP)
            step = vectors[v, lo:hi] - queries[q, lo:hi]
            partial = partial + np.einsum("ij,ij->i", step, step)
            keep = partial <= bound(hi)[q]
            q, v, partial = q[keep], v[keep], partial[keep]
        found_q.append(q)
        found_v.append(v)
        order = np.lexsort((partial, q))
        rank = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        near = np.full((len(queries), k + 1), np.inf, dtype=np.float32)
        few = rank <= k
        near[q[order][few], rank[few]] = partial[order][few]
        best = np.sort(np.hstack([best, near]), axis=1)[:, : k + 1]
        radius = np.minimum(radius, best[:, k] * np.float32(1 + 1e-4))
    return np.concatenate(found_q or [np.zeros(0, int)]), np.concatenate(found_v or [np.zeros(0, int)])


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision, component after component, so that every engine gets the same value."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def nearest(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", every: int = 20, k: int = 20, probe_share: float = 0.65, per_list: int = 1024, sample: int = 16_384, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` its k nearest other rows found.

    Largest inner product first, ties to the smaller vec_id; the search works on vectors scaled by the largest component, scores are
    those of the original vectors. Unusable vectors (see usable) take no part, nor do those of another
    length than most. Repeated rows of an id are one (the least vector). A query probes ``probe_share`` of the lists, nearest first,
    its radius at first is the distance of its 2k-th best sampled vector in these lists and shrinks inside each list; lists
    that lie wholly beyond it are passed over (by the triangle inequality). Lists hold about ``per_list`` vectors up to 4,096 lists and
    more beyond; a list of more than ``block`` vectors is scanned in blocks. Queries that find fewer than k so (or than there are) are compared with every vector. The driver holds the sample, at most 4,096 centroids and list sizes.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, column)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    size = int(common["n"])
    rows = materialize(rows.where(F.size("v") == size).groupBy("vec_id").agg(F.min("v").alias("v")))
    total, largest = rows.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))).first()
    scaled = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.lit(largest)) * (x / F.lit(largest)))
    most = rows.agg(F.max(scaled)).first()[0]
    picked = np.stack(rows.orderBy(F.xxhash64("vec_id")).limit(sample).toPandas()["v"].to_numpy()).astype(np.float64)
    turn = rotation(size + 1)

    def rotated(v: np.ndarray, is_query: bool) -> np.ndarray:
        v = v / largest
        square = (v * v).sum(1)
        if is_query:  # its length changes no ranking, so all get that of the longest vector
            v = v * np.sqrt(most / np.maximum(square, 1e-300))[:, None]
        rest = np.zeros(len(v)) if is_query else np.sqrt(np.maximum(0.0, most - square))
        return np.hstack([v, rest[:, None]]).astype(np.float32) @ turn

    lists = int(min(4096, max(1, total // per_list)))
    centres = kmeans(rotated(picked, False), lists)
    norms = (centres**2).sum(1)

    def assign(frames):
        for pdf in frames:
            v = np.stack(pdf["v"].to_numpy())
            turned = rotated(v, False)
            near = np.argmin(norms - 2 * turned @ centres.T, axis=1)
            yield pd.DataFrame({"list": near, "vec_id": pdf["vec_id"], "v": pdf["v"], "away": np.sqrt(((turned - centres[near]) ** 2).sum(1))})

    placed = materialize(rows.mapInPandas(assign, "list int, vec_id long, v array<double>, away double"))
    counted = {r["list"]: (r["n"], r["away"]) for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away")).collect()}
    sizes = np.array([counted.get(j, (0, 0))[0] for j in range(len(centres))])
    reach = np.array([counted.get(j, (0, 0.0))[1] for j in range(len(centres))])
    blocks = np.maximum(1, -(-sizes // block))

    known = rotated(picked, False)
    known_norms, known_lists = (known**2).sum(1), np.argmin(norms - 2 * known @ centres.T, axis=1)
    ways = max(1, math.ceil((total // every) * probe_share / block))  # so many units share a list's queries

    def probe(frames, probe_share: float, adaptive: bool):
        for pdf in frames:
            v = np.stack(pdf["v"].to_numpy())
            turned = rotated(v, True)
            to_centre = np.maximum(0, (turned**2).sum(1)[:, None] + norms - 2 * turned @ centres.T)
            order = np.argsort(to_centre, axis=1, kind="stable")
            least = np.maximum(0, np.sqrt(to_centre) - reach * (1 + 1e-4) - 1e-4) ** 2  # no vector of the list is nearer
            out = []
            for lo in range(0, len(v), 256):
                part = turned[lo : lo + 256]
                distance = (part**2).sum(1)[:, None] + known_norms - 2 * part @ known.T
                place = np.argsort(order[lo : lo + 256], axis=1)  # the list's turn for each query
                distance[place[:, known_lists] >= math.ceil(probe_share * len(centres))] = np.inf
                radius = np.partition(distance, 2 * k, axis=1)[:, 2 * k] if len(known) > 2 * k else np.full(len(part), np.inf)
                radius = np.where(adaptive, radius, np.inf)
                for q, row, near, r, far in zip(pdf["vec_id"][lo : lo + 256], pdf["v"][lo : lo + 256], order[lo : lo + 256], radius, least[lo : lo + 256], strict=True):
                    seen = np.cumsum(sizes[near])
                    n = max(math.ceil(probe_share * len(near)), int(np.searchsorted(seen, min(k + 1, total))) + 1)
                    out += [((int(j) * ways + int(q) // every % ways) << 20 | b, q, row, float(r)) for j in near[:n] if sizes[j] and far[j] <= r * (1 + 1e-4) for b in range(blocks[j])]
            yield pd.DataFrame(out, columns=["unit", "vec_id", "v", "radius"])

    of_block = F.pmod(F.xxhash64("vec_id"), F.element_at(F.lit(blocks.tolist()), F.col("list") + 1).cast("long"))
    way = F.explode(F.sequence(F.lit(0), F.lit(ways - 1))).alias("way")
    dealt = placed.select("list", "vec_id", "v", of_block.alias("block"), way)
    stored = dealt.select((F.shiftleft(F.col("list").cast("long") * ways + F.col("way"), 20) + F.col("block")).alias("unit"), "vec_id", "v", F.lit(-1.0).alias("radius"))
    queries = rows.where(F.col("vec_id") % every == 0)

    def scan(pdf: pd.DataFrame, adaptive: bool):
        out = []
        for _, unit in pdf.groupby("unit", sort=False):
            asks = unit["radius"].to_numpy() >= 0
            if asks.all() or not asks.any():
                continue
            v, ids = np.stack(unit["v"].to_numpy()), unit["vec_id"].to_numpy()
            store, stored_ids = v[~asks], ids[~asks]
            turned = rotated(store, False)
            wanted, radius = np.flatnonzero(asks), unit["radius"].to_numpy()
            for lo in range(0, len(wanted), 256):
                own = wanted[lo : lo + 256]
                q, x = adaptive_scan(rotated(v[own], True), turned, radius[own], k if adaptive else len(store))
                other = ids[own][q] != stored_ids[x]
                q, x = q[other], x[other]
                score = inner_products(store[x], v[own][q])
                order = np.lexsort((stored_ids[x], -score, q))
                q, x, score = q[order], x[order], score[order]
                best = np.arange(len(q)) - np.searchsorted(q, q) < k
                out.append(pd.DataFrame({"query_id": ids[own][q[best]], "vec_id": stored_ids[x[best]], "score": score[best]}))
        if out:
            yield pd.concat(out, ignore_index=True)

    def merge(pdf: pd.DataFrame):
        pdf = pdf.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
        rank = pdf.groupby("query_id").cumcount() + 1
        kept = rank <= k
        yield pd.DataFrame({"query_id": pdf["query_id"], "rank": rank, "vec_id": pdf["vec_id"], "score": pdf["score"]})[kept]

    def search(these: DataFrame, share: float, adaptive: bool) -> DataFrame:
        asked = these.mapInPandas(lambda frames: probe(frames, share, adaptive), "unit long, vec_id long, v array<double>, radius double")
        found = map_whole_groups(stored.unionByName(asked), "unit", lambda pdf: scan(pdf, adaptive), "query_id long, vec_id long, score double", 4096)
        return map_whole_groups(found, "query_id", merge, schema)

    first = materialize(search(queries, probe_share, True))
    whole = first.groupBy(F.col("query_id").alias("vec_id")).count().where(F.col("count") >= min(k, total - 1)).select("vec_id")
    short = materialize(queries.join(whole, "vec_id", "left_anti"))
    if total < 2 or short.isEmpty():
        return first
    again = search(short, 1.0, False)  # these see every vector
    return first.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
