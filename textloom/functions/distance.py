"""Edit distance on sequences of any hashable items, in Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


RUN = 8  # equal items after which two sequences count as in step again
NEAR = 16  # edits between such runs up to which the bound from above looks


def sequence_distance(a: Sequence, b: Sequence) -> int:
    """Insertions, deletions and substitutions from a to b. Where a bound from above (an alignment from run to run, or place by place)
    meets one from below (lengths, or counts of items), that is the distance, in time proportional to length. Else diagonals are
    followed for as long as that is cheaper than the bit-parallel table."""
    x, y = _numbers(a, b)
    start = _equal_run(x, 0, y, 0)
    x, y = x[start:], y[start:]
    stop = _equal_run(x[::-1], 0, y[::-1], 0)
    x, y = x[: len(x) - stop], y[: len(y) - stop]
    if not len(x) or not len(y):
        return len(x) + len(y)
    most = _aligned(x, y)
    if len(x) == len(y):
        most = min(most, int(np.count_nonzero(x != y)))
    if most == abs(len(x) - len(y)) or most == _least(x, y):
        return most
    within = _diagonals(x, y, min(most, 32 + max(len(x), len(y)) // 20))
    return _bit_parallel(x.tolist(), y.tolist()) if within is None else within


def _numbers(a: Sequence, b: Sequence) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(a, str) and isinstance(b, str):
        return tuple(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for t in (a, b))
    places: dict = {}
    return tuple(np.array([places.setdefault(item, len(places)) for item in t], np.int64) for t in (a, b))


def _equal_run(a: np.ndarray, i: int, b: np.ndarray, j: int) -> int:
    """How many items from i in a and j in b are equal."""
    n, most, step = 0, min(len(a) - i, len(b) - j), 32
    while n < most:
        step = min(step, most - n)
        differs = a[i + n : i + n + step] != b[j + n : j + n + step]
        if differs[k := int(differs.argmax())]:
            return n + k
        n, step = n + step, min(4 * step, 1 << 14)
    return n


def _least(a: np.ndarray, b: np.ndarray) -> int:
    """The distance is no less than the items that only one side has, by their counts."""
    _, places = np.unique(np.concatenate((a, b)), return_inverse=True)
    more = np.bincount(places[: len(a)], minlength=len(places)) - np.bincount(places[len(a) :], minlength=len(places))
    return int(max(more[more > 0].sum(), -more[more < 0].sum()))


def _aligned(a: np.ndarray, b: np.ndarray) -> int:
    """The edits of an alignment that goes from each difference to the next run of equal items by the fewest edits; the length of the
    longer sequence where no run is near."""
    left, right, n, m = a.tolist(), b.tolist(), len(a), len(b)
    i = j = edits = 0
    while True:
        run = _equal_run(a, i, b, j)
        i, j = i + run, j + run
        if i == n or j == m:
            return edits + (n - i) + (m - j)
        reach, found = {0: 0}, None
        for e in range(1, NEAR + 1):
            now = {}
            for k in range(-e, e + 1):
                x = max(reach.get(k, -NEAR) + 1, reach.get(k - 1, -NEAR), reach.get(k + 1, -NEAR) + 1)
                y = x + k
                if x < 0 or y < 0 or i + x > n or j + y > m:
                    continue
                first = x
                while x - first < RUN and i + x < n and j + y < m and left[i + x] == right[j + y]:
                    x, y = x + 1, y + 1
                now[k] = x
                if x - first == RUN or (i + x == n and j + y == m):
                    found = (e, x, y)
                    break
            if found:
                break
            reach = now
        if not found:
            return max(n, m)
        edits, i, j = edits + found[0], i + found[1], j + found[2]


def _diagonals(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The distance if it is no more than ``most``: how far each diagonal gets with 0, 1, 2, ... edits (Ukkonen 1985)."""
    n, m, middle = len(a), len(b), most + 1
    shift = m - n
    x, y = np.append(a, -1), np.append(b, -2)
    far = np.full(2 * most + 3, -n - m - 2, np.int64)
    far[middle] = _equal_run(a, 0, b, 0)
    if shift == 0 and far[middle] == n:
        return 0
    for e in range(1, most + 1):
        low, high = max(-e, shift - (most - e), -n), min(e, shift + (most - e), m)
        if low > high:
            return None
        at = slice(middle + low, middle + high + 1)
        k = np.arange(low, high + 1)
        now = np.maximum(np.maximum(far[at], far[middle + low + 1 : middle + high + 2]) + 1, far[middle + low - 1 : middle + high])
        now = np.minimum(np.minimum(now, n), m - k)
        going = np.flatnonzero(x[now] == y[now + k])
        for _ in range(RUN):
            now[going] += 1
            going = going[x[now[going]] == y[now[going] + k[going]]]
            if not len(going):
                break
        for g in going:
            now[g] += _equal_run(a, now[g], b, now[g] + k[g])
        far[at] = now
        if low <= shift <= high and far[middle + shift] >= n:
            return e
    return None


def _bit_parallel(a: Sequence, b: Sequence) -> int:
    """Bit-parallel (Myers 1999) on integers of any length, so a step of the longer sequence handles all places of the shorter one."""
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a)
    places: dict = {}
    for k, item in enumerate(b):
        places[item] = places.get(item, 0) | 1 << k
    every, last = (1 << len(b)) - 1, 1 << (len(b) - 1)
    up, down, distance = every, 0, len(b)
    for item in a:
        here = places.get(item, 0)
        across = (((here & up) + up) ^ up) | here | down
        plus, minus = down | (every & ~(across | up)), up & across
        distance += (plus & last > 0) - (minus & last > 0)
        plus, minus = (plus << 1 | 1) & every, minus << 1 & every
        up, down = minus | (every & ~(here | down | plus)), plus & (here | down)
    return distance


def token_distance(a: Column, b: Column) -> Column:
    """The edit distance of two arrays of strings."""

    @F.pandas_udf("long")
    def distances(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else sequence_distance(list(x), list(y)) for x, y in zip(left, right, strict=True)], dtype="Int64")

    return distances(a, b)


def text_distance(a: Column, b: Column) -> Column:
    """The edit distance of two texts by characters."""

    @F.pandas_udf("long")
    def distances(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else sequence_distance(x, y) for x, y in zip(left, right, strict=True)], dtype="Int64")

    return distances(a, b)
