"""Shared plumbing: scratch tables, joins on hot keys, whole-group streaming, bucket units, connected components."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than this share of all rows is hot; there are at most HOT_KEYS of them, which bounds what is broadcast.
HOT_KEYS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that is unset, one of the machine's own, but only if there is no other
    machine: a cluster must name a folder that all its machines see."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isEmpty():
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
            current = sc._jsc.sc().getCheckpointDir()
        shared = current.get()
    return shared.rstrip("/")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows while a scratch table is written; the session's own number stands before and after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_open_scopes: list[list[tuple[SparkSession, str]]] = []


def scratch_path(spark: SparkSession) -> str:
    path = f"{scratch_dir(spark)}/textloom-{uuid.uuid4().hex}"
    if _open_scopes:
        _open_scopes[-1].append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_scope():
    """Scratch tables made inside are deleted at the end, so what was built on them must be written by then."""
    _open_scopes.append([])
    try:
        yield
    finally:
        for spark, path in _open_scopes.pop():
            _delete(spark, path)


def materialize(df: DataFrame, codec: str = "none", batch: int = 2000) -> DataFrame:
    """Cut lineage: write df as Parquet into the shared folder and read it back. What is kept so is mostly hashes, which compress
    little; without a codec, readers hold no native memory that only a garbage collection gives back. ``batch`` bounds the rows of
    Arrow batches meanwhile: whole texts make large ones, of which a worker holds several copies."""
    spark = df.sparkSession
    path = scratch_path(spark)
    with arrow_rows(spark, batch):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, column: str, values: tuple[int, ...], codec: str = "none") -> list[DataFrame]:
    """materialize() with a table for each value of ``column``, which they lack, so that each can be dropped by itself."""
    spark = df.sparkSession
    path = scratch_path(spark)
    with arrow_rows(spark, 2000):
        df.write.option("compression", codec).partitionBy(column).parquet(path)
    for value in values:  # a value without rows has no folder
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={value}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)
    return [spark.read.schema(df.drop(column).schema).parquet(f"{path}/{column}={value}") for value in values]


def drop_scratch(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/textloom-" not in path:
                raise ValueError(f"not a scratch table: {path}")
            _delete(spark, path)


def release_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished queries go when the driver's garbage is collected, which may be never while a step runs: collect it."""
    spark._jvm.System.gc()


def repeatable(df: DataFrame) -> DataFrame:
    """df itself where its rows come from files in the same order each time; else written first, so that what reads it twice, or a
    task that runs again after a lost executor, sees the same rows in the same places."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return materialize(df, "zstd") if "Exchange" in plan or "Scan ExistingRDD" in plan or "InMemoryTableScan" in plan else df


def id_key(column: str = "doc_id"):
    """doc_id as text, in which null and every long keep apart on the way through Python workers."""
    return F.col(column).cast("long").cast("string")


def from_key(column):
    return column.cast("long")


def spot(column: str = "doc_id"):
    """doc_id as a value that sorts as the number does, null first, and joins like any other."""
    number = F.col(column).cast("long")
    return F.struct(number.isNotNull().alias("known"), F.coalesce(number, F.lit(0)).alias("id"))


def from_spot(column):
    return F.when(column["known"], column["id"])


def join_hot(rows: DataFrame, facts: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """rows with the facts of their key (one row of facts for a key; ``count`` says how many rows have it).

    Keys with more than 1 / HOT_KEYS of all rows are fewer than HOT_KEYS, so their facts are broadcast and their rows stay where they
    are; the other rows are shuffled by key. Both inputs should be tables, since they are read more than once.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    hot = facts.where(F.col(count) * HOT_KEYS > F.lit(total))
    some = F.broadcast(hot.select(key))
    cold = facts.where(F.col(count) * HOT_KEYS <= F.lit(total))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(some, key, "left_anti").join(cold, key, how))


def whole_groups(frames: Iterator[pd.DataFrame], key: str, at_least: int = 4096) -> Iterator[pd.DataFrame]:
    """Frames sorted by key, cut only between groups; at most one batch and one group are held."""
    held: list[pd.DataFrame] = []
    rows, goal = 0, at_least
    for pdf in frames:
        held.append(pdf)
        rows += len(pdf)
        if rows < goal:
            continue
        whole = pd.concat(held, ignore_index=True)
        keys = whole[key].to_numpy()
        first = int(np.argmax(keys == keys[-1]))
        if first:
            yield whole.iloc[:first].reset_index(drop=True)
        held, rows = [whole.iloc[first:]], len(whole) - first
        goal = max(at_least, 2 * rows)
    if rows:
        yield pd.concat(held, ignore_index=True)


def map_whole_groups(df: DataFrame, key: str, fn: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], schema: str, at_least: int = 4096) -> DataFrame:
    """fn over frames of many whole groups of ``key`` (groups must be small: see bucket_units)."""

    def run(frames):
        for pdf in whole_groups(frames, key, at_least):
            yield from fn(pdf)

    return df.repartition(key).sortWithinPartitions(key).mapInPandas(run, schema)


def bucket_units(rows: DataFrame, key: str, member: str, limit: int) -> DataFrame:
    """Give rows of buckets with two or more members the columns ``unit`` (long) and ``half``.

    A bucket of at most ``limit`` members is one unit. A larger one is dealt into g blocks by the member's hash and every
    pair of blocks is a unit, so all pairs still meet, in pieces of about 2 * limit rows; a member is sent to g units. half is 0 where
    a unit holds one block, else 1 or 2: pairs with halves 0, 0 or 1, 2 (see own_pairs) occur in one unit only.

    Rows of a hot bucket never gather before they are dealt: see join_hot. ``rows`` should come from a table.
    """
    sizes = materialize(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    is_hot = (F.col("_n") > limit) & (F.col("_n") * HOT_KEYS > F.lit(total))
    hot = sizes.where(is_hot)
    # the sizes are the far smaller side, so they are hashed and the rows needn't be sorted
    found = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(sizes.where(~is_hot).hint("shuffle_hash"), key)
    if not hot.isEmpty():
        found = found.unionByName(rows.join(F.broadcast(hot), key))
    block = F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.col("_g")).cast("int")
    placed = found.withColumn("_g", F.ceil(F.col("_n") / F.lit(limit)).cast("int")).withColumn("_b", F.when(F.col("_g") == 1, F.lit(0)).otherwise(block))
    other = F.explode(F.sequence(F.lit(0), F.col("_g") - 1))
    half = F.when(F.col("_b") == F.col("_o"), F.lit(0)).when(F.col("_b") < F.col("_o"), F.lit(1)).otherwise(F.lit(2))
    unit = F.xxhash64(F.col(key), F.least("_b", "_o"), F.greatest("_b", "_o"))
    return placed.withColumn("_o", other).withColumn("unit", unit).withColumn("half", half).drop("_n", "_g", "_b", "_o")


def own_pairs(half: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs belong to the unit: all of a block's own, else those between its two blocks."""
    return (half[i] + half[j]) % 3 == 0


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a long, b long): (node, root), root the least node.

    Alternating large-star and small-star rounds (Kiveris et al. 2014); each round is a minimum per node and a join, its
    result a table in the shared folder, so neither links nor labels come to the driver. Stops when a round changes no edge; rounds grow
    with the logarithm of the largest component.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def stats(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def star(df, large: bool):
        both = df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else df
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # the key is made anew, so that both sides of the join are shuffled and a node with very many links can be split
        moved = both.join(least.select(F.col("a").bitwiseXOR(F.lit(0)).alias("_a"), "m"), F.col("a") == F.col("_a"))
        if large:
            out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    before = stats(now)
    while before[0]:
        last, now = now, materialize(star(star(now, True), False))
        drop_scratch(last)
        after = stats(now)
        if tuple(after) == tuple(before):
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


class Forest:
    """Union-find over 0..n-1, the smaller index as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if x > y:
            x, y = y, x
        self.up[y] = x
        return True

    def stars(self, names: np.ndarray) -> pd.DataFrame:
        """(a, b): each tree as links from its root to its other members, so that components settle in few rounds."""
        root = np.fromiter(map(self.find, range(len(self.up))), dtype=np.int64, count=len(self.up))
        other = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": names[root[other]], "b": names[other]}, dtype="int64")


def group_bounds(keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys, and the length at the end."""
    if not len(keys):
        return np.zeros(1, dtype=np.int64)
    return np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]


def group_pairs(bounds: np.ndarray, chunk: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j inside each run, in chunks of about ``chunk`` pairs."""
    left, right, held = [], [], 0
    cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        n = int(hi - lo)
        if n < 2:
            continue
        if n not in cache:
            if len(cache) > 64:
                cache.clear()
            cache[n] = np.triu_indices(n, 1)
        i, j = cache[n]
        left.append(i + lo)
        right.append(j + lo)
        held += len(i)
        if held >= chunk:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def binomial_tail_below(n: int, m: int, t: float) -> float:
    """P(similarity >= t) after m of n values agree, uniform prior: P(Bin(n + 1, t) <= m)."""
    return sum(math.comb(n + 1, k) * t**k * (1 - t) ** (n + 1 - k) for k in range(m + 1))
