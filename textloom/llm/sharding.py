"""Sharding by minimax contiguous partition.

Equal texts form an atomic group; groups are ordered by a 64-bit hash of the text. The smallest shard capacity for which cutting
greedily needs no more than the wanted shards is found by binary search, then the order is cut. The search sees sums over ranges
of the order: 4096 ranges at first, then only those in which a cut may fall are divided by 256, until they hold one group each.
So it is exact, and what the driver holds depends on the number of shards, not on the data.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import from_spot, materialize, spot


def _feasible(sizes, atomic, capacity, shards, whole) -> bool:
    """Whether cutting greedily needs at most ``shards`` shards. Ranges of one group are never divided, others freely (whole: not either)."""
    done, room = 1, capacity
    for size, one in zip(sizes, atomic, strict=True):
        if one or whole:
            if size > capacity:
                return False
            if size > room:
                done, room = done + 1, capacity
            room -= size
        else:
            if size > room:
                size -= room
                more = math.ceil(size / capacity)
                done, room = done + more, more * capacity - size
            else:
                room -= size
        if done > shards:
            return False
    return True


def least_capacity(sizes: list[int], atomic: list[bool], shards: int, whole: bool) -> int:
    low, high = max(1, -(-sum(sizes) // shards)), max(1, sum(sizes))
    while low < high:
        mid = (low + high) // 2
        if _feasible(sizes, atomic, mid, shards, whole):
            high = mid
        else:
            low = mid + 1
    return low


def _touched(sizes, atomic, low, high, shards) -> set[int]:
    """Ranges that are not atomic and in which a greedy cut from either end may fall, for capacities low to high."""
    ends = np.cumsum(sizes)
    total, out = int(ends[-1]), set()
    early = late = 0
    for _ in range(shards):
        at = int(np.searchsorted(ends, early + low, side="right"))
        early = int(ends[at - 1]) if at else early  # cuts at the latest whole range before
        late = min(total, late + high)
        a, b = int(np.searchsorted(ends, early, side="right")), int(np.searchsorted(ends, late, side="left"))
        out |= {k for k in range(max(0, a - 1), min(len(sizes), b + 2)) if not atomic[k]}
        if early >= total:
            break
    early, late = total, total
    for _ in range(shards):
        late = max(0, late - high)
        at = int(np.searchsorted(ends, early - low, side="left"))
        early = int(ends[at]) if at < len(ends) and ends[at] < early else early
        a, b = int(np.searchsorted(ends, late, side="right")), int(np.searchsorted(ends, early, side="left"))
        out |= {k for k in range(max(0, a - 1), min(len(sizes), b + 2)) if not atomic[k]}
    return out


def cut_positions(sizes: list[int], capacity: int, shards: int) -> list[int]:
    """Indexes at which shards 1, 2, ... start. Every shard stays within ``capacity``; within what that leaves free (between the
    greedy cuts from the left and from the right) each cut is the one nearest to an even division of the rest."""
    ends = np.r_[0, np.cumsum(sizes)]
    total, n = int(ends[-1]), len(sizes)
    last = [n]
    for _ in range(shards - 1):  # the earliest start of shard k for which the rest still fits
        last.append(int(np.searchsorted(ends, ends[last[-1]] - capacity, side="left")))
    earliest, cuts, at = last[::-1], [], 0
    for k in range(1, shards):
        most = int(np.searchsorted(ends, ends[at] + capacity, side="right")) - 1
        want = ends[at] + (total - ends[at]) / (shards - k + 1)
        near = int(np.searchsorted(ends, want))
        near = near - 1 if near and want - ends[near - 1] <= ends[min(near, n)] - want else near
        at = min(max(near, earliest[k - 1], at + 1), max(most, at), n)  # a shard has a group, as long as there are groups
        cuts.append(at)
    return cuts


def boundaries(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """(least order of shards 1, 2, ..., capacity) for rows (order long, size long), order being a hash over all of long.

    A range is (its first order, bits that are fixed).
    """
    def sums(rows: DataFrame, bits: int):
        first = F.shiftleft(F.shiftright("order", 64 - bits), 64 - bits)
        return rows.groupBy(first.alias("first")).agg(F.sum("size").alias("size"), F.min("order").alias("low"), F.max("order").alias("high")).collect()

    ranges = sorted((r["low"], r["high"], int(r["size"]), 12, r["first"]) for r in sums(groups, 12))
    if not ranges:
        return [], 1
    while True:
        sizes, atomic = [r[2] for r in ranges], [r[0] == r[1] for r in ranges]
        low, high = least_capacity(sizes, atomic, shards, False), least_capacity(sizes, atomic, shards, True)
        divide = _touched(sizes, atomic, low, high, shards)
        if not divide:
            break
        bits = min(ranges[k][3] for k in divide)
        now = [k for k in divide if ranges[k][3] == bits]
        more = min(64, bits + 8)
        chosen = groups.where(F.shiftleft(F.shiftright("order", 64 - bits), 64 - bits).isin([ranges[k][4] for k in now]))
        gone = set(now)
        ranges = sorted([r for k, r in enumerate(ranges) if k not in gone] + [(r["low"], r["high"], int(r["size"]), more, r["first"]) for r in sums(chosen, more)])
    capacity = least_capacity(sizes, atomic, shards, True)
    starts = [r[0] for r in ranges]
    return [starts[k] if k < len(starts) else 2**63 - 1 for k in cut_positions(sizes, capacity, shards)], capacity


def by_bytes(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard, group_order.

    size is the text's UTF-8 bytes (null: none) plus 8. Equal texts (null equals empty) stay together, so the largest group bounds
    how even shards can be; groups of more than an even share (fewer than ``shards``) come first in the order, so that what follows
    divides evenly. With fewer groups than shards some shards are empty. Slots number a shard's rows from 0. grown_shard is null under this law. Null ids take part; repeated rows each get a slot.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = materialize(docs.select(spot().alias("key"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("order")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    large = [r[0] for r in rows.groupBy("order").agg(F.sum("size").alias("n")).where(F.col("n") * shards > total).orderBy("order").select("order").collect()]
    for k, order in enumerate(large):
        rows = rows.withColumn("order", F.when(F.col("order") == order, F.lit(k - 2**63)).otherwise(F.col("order")))
    starts, _ = boundaries(rows, shards)
    placed = rows.withColumn("shard", sum(((F.col("order") >= F.lit(s)) & F.lit(s < 2**63 - 1)).cast("int") for s in starts) if starts else F.lit(0))
    slotted = with_rank(placed, ["shard"], F.shiftright("order", 54).cast("int"), ["order", "key"], "slot")
    return slotted.select(from_spot(F.col("key")).alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("order").alias("group_order"))


def with_rank(rows: DataFrame, within: list[str], part: Column, order: list[str], column: str, salts: int = 32) -> DataFrame:
    """Gapless ranks from 0 (long) in each group of ``within``, without gathering a group in one task.

    Rows are ranked inside cells (group, ordered part, salt of the order columns); a cell's first rank is the number of rows in the
    cells before it, from counts per cell. Only cells of equal groups come together: their number is fixed by part and salts.
    """
    from pyspark.sql import Window

    celled = rows.withColumn("_p", part).withColumn("_s", F.pmod(F.xxhash64(*order, F.lit(3)), F.lit(salts)).cast("int"))
    cell = [*within, "_p", "_s"]
    counts = celled.groupBy(*cell).agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.partitionBy(*within).orderBy("_p", "_s").rowsBetween(Window.unboundedPreceding, -1))).drop("_c")
    ranked = celled.withColumn("_r", F.row_number().over(Window.partitionBy(*cell).orderBy(*order)))
    return ranked.join(before, cell).withColumn(column, (F.coalesce("_before", F.lit(0)) + F.col("_r") - 1).cast("long")).drop("_p", "_s", "_before", "_r")
