"""Fuzzy line deduplication: MinHash bands of word pairs, edit similarity, one occurrence kept per connected group.

Lines are normalised (lower case, ASCII marks to spaces, digits to 0). Equal lines are one from the start. Of a line's word pairs
(with its beginning and end as words) come MinHash values, three to a band; lines that agree on a band meet, whatever else they are,
and edit similarity of the normalised lines alone decides whether they are near. It is looked at inside the bands' own units, so that
chance meetings tie nothing together, and only in the first band in which a pair meets. Of each connected group the first occurrence is kept.

The method asked for blocks of a SimHash. It can't find near lines: one replaced word of six turns about a fifth of a SimHash's bits,
and no choice of blocks that finds such pairs keeps unrelated lines apart (figures in the README).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Forest, components, drop_scratch, from_spot, group_bounds, group_pairs, map_whole_groups, materialize, materialize_by, own_pairs, release_shuffles, spot, whole_groups
from .shingles import WordHasher, mix64, text_groups

#: Bands, MinHash values of a band, and bytes of a band's key.
BANDS, ROWS, WIDTH = 20, 3, 5
#: Buckets of the bit table that says which texts may have wanted lines.
BITS = 1 << 20
#: Ranges of digests by which lines are dealt out (a power of two), and lines of a task that are dealt together.
RANGES, HELD = 1 << 10, 1 << 17
#: Bits of a unit's name by which units are dealt out.
FAMILY = 24
#: Members of a large bucket that all its blocks hold, and the half of their rows outside their own block.
ANCHORS, GUEST = 16, 3
#: Columns of a line in byte strings (see line_pieces), and their kinds.
KINDS = {"known": "u1", "id": "<i8", "th": "<i8", "line": "<i4", "words": "<i4", "local": "<i4", "h": "<u8", "n": "<i8", "at": "<i4", "has": "u1", "bands": "u1"}
ODD = np.random.default_rng(11).integers(0, 1 << 31, (BANDS, ROWS), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _byte_map() -> bytes:
    """ASCII marks and controls but the line end to spaces, digits to 0."""
    out = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        if c.isdigit():
            out[b] = ord("0")
        elif not c.isalnum() and c != "\n":
            out[b] = ord(" ")
    return bytes(out)


BYTES = _byte_map()


def normalised(line: str) -> str:
    return " ".join(w for w in line.lower().encode("utf-8", "surrogatepass").translate(BYTES).decode("utf-8", "surrogatepass").split(" ") if w)


def line_bands(word: np.ndarray, lo: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of the bands of each line, as rows of bytes; line i has the words from lo[i] on."""
    at = lo + np.arange(len(lo))
    padded = np.zeros(len(word) + len(lo) + 1, dtype=np.uint64)
    padded[np.arange(len(word)) + 1 + np.repeat(np.arange(len(lo)), words)] = word
    with np.errstate(over="ignore"):
        pairs = (mix64(padded[:-1] * np.uint64(0x9E3779B97F4A7C15) + padded[1:]) >> np.uint64(32)).astype(np.uint32)
        out = np.empty((len(lo), BANDS, WIDTH), dtype=np.uint8)
        for k in range(BANDS):
            key = np.zeros(len(lo), dtype=np.uint64)
            for odd in ODD[k]:
                key = mix64(key + np.minimum.reduceat(pairs * odd, at).astype(np.uint64) + np.uint64(1))
            out[:, k] = key.view(np.uint8).reshape(-1, 8)[:, :WIDTH]
    return out.reshape(len(lo), -1)


def line_hashes(texts: list[str], hasher: WordHasher):
    """For all lines of the texts that have words: (text, line number, words, digests of the normalised lines, keys of line_bands)."""
    raw = ("\n".join(t.lower() for t in texts) + "\n").encode("utf-8", "surrogatepass").translate(BYTES)
    data = np.frombuffer(raw, dtype=np.uint8)
    stop = np.flatnonzero((data == 32) | (data == 10))
    start = np.r_[0, stop[:-1] + 1]
    line = np.r_[0, np.cumsum(data[stop] == 10)[:-1]]
    lines = np.fromiter((t.count("\n") + 1 for t in texts), dtype=np.int64, count=len(texts))
    total = int(lines.sum())
    real = stop > start
    start, stop, line = start[real], stop[real], line[real]
    words = np.bincount(line, minlength=total)
    first = np.r_[0, np.cumsum(words)]
    text = np.repeat(np.arange(len(texts)), lines)
    number = np.arange(total) - np.repeat(np.cumsum(lines) - lines, lines)
    some = np.flatnonzero(words)
    kept = data != 32  # of spaces one between two words of a line
    kept[stop[:-1][line[1:] == line[:-1]]] = True
    digests = [hashlib.md5(x).digest() for x in data[kept].tobytes().split(b"\n") if x]
    bands = line_bands(hasher(data, start, stop), first[some], words[some]) if len(some) else np.zeros((0, BANDS * WIDTH), np.uint8)
    return text[some], number[some], words[some], digests, bands


def without_ends(a: str, b: str, step: int = 64) -> tuple[str, str]:
    """The texts without their common beginning and, of the rest, the common end."""
    k, n = 0, min(len(a), len(b))
    for size in (step, 8):
        while k + size <= n and a[k : k + size] == b[k : k + size]:
            k += size
    while k < n and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    k, n = 0, n - k
    for size in (step, 8):
        while k + size <= n and a[len(a) - k - size : len(a) - k] == b[len(b) - k - size : len(b) - k]:
            k += size
    while k < n and a[-1 - k] == b[-1 - k]:
        k += 1
    return a[: len(a) - k], b[: len(b) - k]


def edit_within(a: str, b: str, limit: int) -> bool:
    """Whether the edit distance is at most ``limit`` (bit-parallel, Myers 1999), common ends aside."""
    if abs(len(a) - len(b)) > limit:
        return False
    a, b = without_ends(a, b)
    if max(len(a), len(b)) <= limit:
        return True
    if not a or not b:
        return False
    if len(a) < len(b):
        a, b = b, a
    full, top, at = (1 << len(b)) - 1, 1 << (len(b) - 1), {}
    for k, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << k
    up, down, distance = full, 0, len(b)
    for k, c in enumerate(a):
        eq = at.get(c, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (full & ~(h | up)), up & h
        distance += bool(plus & top) - bool(minus & top)
        if distance - (len(a) - 1 - k) > limit:
            return False
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = minus | (full & ~(v | plus)), plus & v
    return distance <= limit


def within_many(texts: list[str], i: np.ndarray, j: np.ndarray, limit: np.ndarray, few: int = 24, lanes: int = 1 << 14, letters: int = 1 << 20) -> np.ndarray:
    """edit_within for many pairs of texts at once: pairs of like length share a batch (see _batch_within), unless they are ``few``."""
    out = np.zeros(len(i), dtype=bool)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    swap = size[i] < size[j]
    a, b = np.where(swap, j, i), np.where(swap, i, j)
    out[limit >= size[a]] = True
    todo = np.flatnonzero((size[a] - size[b] <= limit) & (limit < size[a]))
    todo = todo[np.argsort(size[a[todo]], kind="stable")]
    length, lo = size[a[todo]], 0
    while lo < len(todo):
        # texts are padded to the longest of their batch, which is not much longer than the shortest
        hi = int(np.searchsorted(length, length[lo] * 1.3 + 32, "right"))
        wide = 2 + int(2 * limit[todo[lo:hi]].max()) // 64
        hi = min(hi, lo + max(few, min(lanes // wide, letters // int(length[hi - 1]))))
        batch = todo[lo:hi]
        if len(batch) < few:
            out[batch] = [edit_within(texts[x], texts[y], int(most)) for x, y, most in zip(a[batch], b[batch], limit[batch], strict=True)]
        else:
            out[batch] = _batch_within([texts[x] for x in a[batch]], [texts[y] for y in b[batch]], limit[batch])
        lo = hi
    return out


def _batch_within(a: list[str], b: list[str], limit: np.ndarray) -> np.ndarray:
    """Which edit distances are within limit (a the longer of each pair): Myers' bit vectors in blocks of 64 rows (Hyyrö 2003), all
    pairs and blocks of a step in one numpy operation, block w one column behind block w - 1.

    Both texts of a pair are padded in front by the same letters, which changes no distance, so that all ``a`` are of one length.
    Blocks further than the largest limit from the diagonal are left out, which only alignments of more cost reach.
    Every 32 steps the pairs go whose cells of the step, through one of which every alignment leads, are all beyond their limit.
    """
    pairs, n = len(a), max(map(len, a))
    pad = np.array([n - len(x) for x in a])
    rows = np.array([len(y) for y in b]) + pad
    blocks, k = -(-int(rows.max()) // 64), int(limit.max()) + 1
    code_a = np.frombuffer("".join(x.rjust(n, "\n") for x in a).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code_b = np.frombuffer("".join("\n" * p + y for p, y in zip(pad, b, strict=True)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    rank = np.zeros(1 + int(max(code_a.max(), code_b.max())), dtype=np.int64)
    rank[code_b] = 1
    letters = np.flatnonzero(rank)
    if pairs > 1 and blocks * (len(letters) + 1) * pairs > 1 << 22:
        half = pairs // 2
        return np.concatenate([_batch_within(a[:half], b[:half], limit[:half]), _batch_within(a[half:], b[half:], limit[half:])])
    rank[:] = len(letters)
    rank[letters] = np.arange(len(letters))
    code, code_b = rank[code_a].reshape(pairs, n), rank[code_b]
    own = np.repeat(np.arange(pairs), rows)
    row = np.arange(len(own)) - np.repeat(np.cumsum(rows) - rows, rows)
    width = (len(letters) + 1) * pairs
    equal = np.zeros(blocks * width, dtype=np.uint64)
    np.bitwise_or.at(equal, (row >> 6) * width + code_b * pairs + own, np.uint64(1) << (row & 63).astype(np.uint64))
    at = np.ascontiguousarray((code * pairs + np.arange(pairs)[:, None]).T)  # by column of the matrix
    base = (np.arange(blocks) * width)[:, None]

    w = np.arange(blocks)
    begin, end = np.maximum(0, 64 * w - k) + w, np.minimum(n - 1, 64 * w + 63 + k) + w  # first and last step of each block
    up, down = np.full((blocks, pairs), ~np.uint64(0)), np.zeros((blocks, pairs), dtype=np.uint64)
    plus, minus = np.ones((blocks + 1, pairs), dtype=np.uint64), np.zeros((blocks + 1, pairs), dtype=np.uint64)  # what a block hands to the next
    score = np.zeros((blocks, pairs), dtype=np.int64)  # distance in a block's last row
    one, last, six = np.uint64(1), np.uint64(63), np.uint64(16)
    alive, result, lo, hi = np.arange(pairs), np.zeros(pairs, dtype=bool), 0, 0
    for t in range(int(end[-1]) + 1):
        while hi < blocks and begin[hi] <= t:
            score[hi] = 64 if not hi else score[hi - 1] - plus[hi].astype(np.int64) + minus[hi].astype(np.int64) + 64
            if hi and begin[hi] == hi:  # starts in the first column
                score[hi] = 64 * (hi + 1)
            hi += 1
        while end[lo] < t:
            lo += 1
        eq = equal[at[t - hi + 1 : t - lo + 1][::-1] + base[lo:hi]]
        pv, mv, p, m = up[lo:hi], down[lo:hi], plus[lo:hi], minus[lo:hi]
        xv = eq | mv
        eq |= m
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        out_plus, out_minus = ph >> last, mh >> last
        ph = ph << one | p
        mh = mh << one | m
        up[lo:hi] = mh | ~(xv | ph)
        down[lo:hi] = ph & xv
        score[lo:hi] += out_plus.view(np.int64) - out_minus.view(np.int64)
        plus[lo + 1 : hi + 1], minus[lo + 1 : hi + 1] = out_plus, out_minus
        plus[lo], minus[lo] = 1, 0  # above the first block distances grow by one a column at most
        if t % 32 == 31 and t < end[-1] - 32:
            best = np.full(len(alive), 1 << 40)
            here, pv, mv = score[lo:hi].copy(), up[lo:hi].copy(), down[lo:hi].copy()
            ahead = (rows[alive] - n + t - w[lo:hi, None]) - 64 * w[lo:hi, None]  # rows left less columns left, at the row before the block
            for part in (3, 2, 1, 0):  # sixteen rows each, from below; none is lower than its last less its rises
                rise, fall = np.bitwise_count(pv >> np.uint64(48)).astype(np.int64), np.bitwise_count(mv >> np.uint64(48)).astype(np.int64)
                far = np.maximum(np.maximum(ahead - 16 * part - 17, 16 * part - ahead - 1), 0)
                best = np.minimum(best, (here - rise + far).min(0))
                here, pv, mv = here - rise + fall, pv << six, mv << six
            keep = best <= limit[alive] + 2  # two, as an alignment may pass between the cells of two blocks
            if keep.sum() < 0.75 * len(keep):
                alive = alive[keep]
                if not len(alive):
                    return result
                up, down, score, at = up[:, keep], down[:, keep], score[:, keep], np.ascontiguousarray(at[:, keep])
                plus, minus = plus[:, keep], minus[:, keep]
    # the last row lies in the last block or, with shorter b, in one before
    final = (rows[alive] - 1) >> 6
    spare = (63 - ((rows[alive] - 1) & 63)).astype(np.uint64)
    cols = np.arange(len(alive))
    over = lambda v: np.where(spare > 0, np.bitwise_count(v[final, cols] >> (np.uint64(64) - np.maximum(spare, one))), 0).astype(np.int64)
    result[alive] = score[final, cols] - over(up) + over(down) <= limit[alive]
    return result


def cost_at_most(a: str, b: str, most: int = 1 << 60, depth: int = 16, pieces: tuple[int, ...] = (12, 6)) -> int:
    """An upper bound of the edit distance: common ends aside, a piece from the middle that both have parts the rest in two. Nothing is
    looked for that can't bring it to ``most``."""
    a, b = without_ends(a, b)
    for piece in pieces if depth else ():
        if len(a) > 2 * piece and len(b) > piece:
            for mid in (len(a) // 2, len(a) // 4, 3 * len(a) // 4):
                lo = mid - piece // 2
                shift = 32 + abs(len(a) - len(b)) + len(a) // 32  # not far from its own place, if it is there
                at = b.find(a[lo : lo + piece], max(0, lo - shift), lo + shift + piece)
                at = b.find(a[lo : lo + piece]) if at < 0 else at
                if at < 0 or abs(lo - at) + abs(len(a) - lo - len(b) + at) > most:
                    continue
                first = cost_at_most(a[:lo], b[:at], most, depth - 1, pieces)
                if first > most:
                    return first + max(len(a) - lo, len(b) - at) - piece
                return first + cost_at_most(a[lo + piece :], b[at + piece :], most - first, depth - 1, pieces)
    return max(len(a), len(b))


def pair_counts(texts: list[str], size: np.ndarray, buckets: int = 256) -> np.ndarray:
    """How often each bucket's pairs of neighbouring characters occur in each text (int16 suffices for a bound: counts are cut)."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(texts)), size)
    inside = row[1:] == row[:-1]
    gram = (code[:-1][inside].astype(np.int64) * 31 + code[1:][inside]) % buckets
    return np.minimum(np.bincount(row[1:][inside] * buckets + gram, minlength=len(texts) * buckets), 32_000).reshape(len(texts), buckets).astype(np.int16)


def may_be_within(counts: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray, chunk: int = 8192) -> np.ndarray:
    """Which pairs may have an edit distance within limit: an edit takes at most two pairs of characters away and brings at most two,
    and of what is taken and what is brought the larger is half of the sum and of the difference."""
    total, parts = counts.sum(1, dtype=np.int64), []
    for lo in range(0, len(i), chunk):
        x, y = i[lo : lo + chunk], j[lo : lo + chunk]
        parts.append(np.abs(counts[x] - counts[y]).sum(1, dtype=np.int64) + np.abs(total[x] - total[y]) <= 4 * limit[lo : lo + chunk])
    return np.concatenate(parts) if parts else np.zeros(0, dtype=bool)


def letter_steps(texts: list[str], size: np.ndarray, step: np.ndarray, cells: int, buckets: int) -> np.ndarray:
    """How often each bucket's letters occur in each text's first 0, 1, ... ``cells`` steps of so many letters (cut to int16)."""
    out = np.zeros((len(texts), cells + 1, buckets), dtype=np.int16)
    for lo in range(0, len(texts), 512):
        some, n = texts[lo : lo + 512], size[lo : lo + 512]
        code = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) % buckets
        row = np.repeat(np.arange(len(some)), n)
        cell = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) // step[lo : lo + 512][row]
        counts = np.bincount((row * cells + cell) * buckets + code, minlength=len(some) * cells * buckets)
        np.cumsum(counts.reshape(len(some), cells, buckets), axis=1, out=out[lo : lo + 512, 1:], dtype=np.int16)
    return out


def halves_may_be_within(texts: list[str], size: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray, cells: int = 64, buckets: int = 32, chunk: int = 4096) -> np.ndarray:
    """Which pairs may have an edit distance within limit by the letters of their halves: an alignment takes the first half of one
    text to some beginning of the other, at most limit letters longer or shorter, and the rest to the rest. Beginnings are looked at
    in steps; of one letter more or less the bound changes by two at most. Nothing is said of texts of more than 32,000 letters."""
    out = np.ones(len(i), dtype=bool)
    todo = np.flatnonzero(np.maximum(size[i], size[j]) <= 32_000)
    for part in (todo[lo : lo + chunk] for lo in range(0, len(todo), chunk)):
        used, at = np.unique(np.concatenate([i[part], j[part]]), return_inverse=True)
        x, y, most = at[: len(part)], at[len(part) :], limit[part]
        n = size[used]
        step = np.maximum(1, -(-n // cells))
        seen = letter_steps([texts[k] for k in used.tolist()], n, step, cells, buckets)
        middle = np.minimum(n, cells // 2 * step)[x]
        first, rest = seen[x, cells // 2], seen[x, cells] - seen[y, cells]
        low, high = np.maximum(0, (middle - most) // step[y]), np.minimum(cells, -(-(middle + most) // step[y]))
        best = np.full(len(part), 1 << 40)
        for g in range(int(low.min()), int(high.max()) + 1):
            now = np.flatnonzero((low <= g) & (g <= high))
            one = first[now] - seen[y[now], g]
            more = middle[now] - np.minimum(n[y[now]], g * step[y[now]])
            two, other = rest[now] - one, n[x[now]] - n[y[now]] - more
            cost = np.abs(one).sum(1, dtype=np.int64) + np.abs(more) + np.abs(two).sum(1, dtype=np.int64) + np.abs(other)
            best[now] = np.minimum(best[now], cost // 2)
        out[part] = best - step[y] // 2 * 2 <= most
    return out


class Undecided:
    """Pairs of lines that bounds don't decide, gathered over many units so that their distances are found many at once."""

    def __init__(self):
        self.parts, self.texts, self.held, self.group = [], {}, 0, {}

    def add(self, rid: np.ndarray, texts: list[str], i: np.ndarray, j: np.ndarray, limit: np.ndarray, forest: Forest, group: np.ndarray) -> None:
        """Pairs of a part's lines; of what the part's forest joins the lines of these pairs are told. ``group`` as in _between."""
        used = np.unique(np.concatenate([i, j]))
        for k in used.tolist():
            if (name := int(rid[k])) not in self.texts:
                self.texts[name] = texts[k]
                self.held += len(texts[k])
        order = np.argsort(j, kind="stable")
        turn = np.empty(len(j), dtype=np.int64)  # which of its second line's pairs a pair is
        bounds = group_bounds(j[order])
        turn[order] = np.arange(len(j)) - np.repeat(bounds[:-1], np.diff(bounds))
        root = np.fromiter(map(forest.find, used.tolist()), dtype=np.int64, count=len(used))
        self.parts.append((rid[i], rid[j], limit, turn, rid[used], rid[root]))
        told = np.concatenate([used, root])
        self.group.update(zip(rid[told].tolist(), group[told].tolist(), strict=True))
        self.held += 32 * len(i)

    def settle(self) -> pd.DataFrame:
        """(a, b) of the near ones. A line meets one line at first, then ever more, so that few pairs already joined are compared."""
        first, second, limit, turn, known, root = map(np.concatenate, zip(*self.parts, strict=True))
        names, at = np.unique(np.concatenate([first, second, known, root]), return_inverse=True)
        x, y, known, root = np.split(at, np.cumsum([len(first), len(second), len(known)]))
        texts = [self.texts.get(n, "") for n in names.tolist()]
        group = np.fromiter((self.group[n] for n in names.tolist()), dtype=np.int64, count=len(names))
        self.parts, self.texts, self.held, self.group = [], {}, 0, {}
        forest = Forest(len(names))
        for p, q in zip(known.tolist(), root.tolist(), strict=True):
            forest.join(p, q)
        done = 0
        while len(x):
            done, now = 4 * done + 1, turn <= 4 * done
            apart = now & np.fromiter((forest.find(p) != forest.find(q) for p, q in zip(x.tolist(), y.tolist(), strict=True)), dtype=bool, count=len(x))
            p, q = x[apart], y[apart]
            near = within_many(texts, p, q, limit[apart])
            for u, v in zip(p[near].tolist(), q[near].tolist(), strict=True):
                forest.join(u, v)
            x, y, limit, turn = x[~now], y[~now], limit[~now], turn[~now]
        return _between(forest, names, group)


def _between(forest: Forest, names: np.ndarray, group: np.ndarray) -> pd.DataFrame:
    """The forest's trees as links between ``group``: a line's own name or the root of lines it is already joined to."""
    links = forest.stars(np.arange(len(names)))
    a, b = group[links["a"].to_numpy()], group[links["b"].to_numpy()]
    return pd.DataFrame({"a": a[a != b], "b": b[a != b]}).drop_duplicates()


def near_edges(frames, similarity: float, letters: int = 1 << 21, pending: int = 1 << 23):
    """Links (a, b) that tie near lines of a unit together, from rows (unit, half, rid, band, text) sorted by unit. ``letters``
    bounds what is looked at together, whole units apart; ``pending`` the letters of undecided lines. With a column root, lines of one
    root count as joined, and links are those between roots."""
    undecided = Undecided()
    for whole in whole_groups(frames, "unit", 2048):
        heads = group_bounds(whole["unit"].to_numpy())
        before = np.r_[0, np.cumsum(whole["text"].str.len().to_numpy())][heads]
        lo = 0
        while lo < len(heads) - 1:
            hi = max(lo + 1, int(np.searchsorted(before, before[lo] + letters, "right")) - 1)
            yield near_part(whole.iloc[heads[lo] : heads[hi]], similarity, undecided)
            lo = hi
            if undecided.held > pending:
                yield undecided.settle()
    if undecided.parts:
        yield undecided.settle()


def near_part(pdf: pd.DataFrame, similarity: float, undecided: Undecided) -> pd.DataFrame:
    """Links of the pairs that bounds decide; the others go to ``undecided``."""
    bounds, half, band = group_bounds(pdf["unit"].to_numpy()), pdf["half"].to_numpy(), pdf["band"].to_numpy()
    rid, first, node = np.unique(pdf["rid"].to_numpy(), return_index=True, return_inverse=True)
    text = pdf["text"].iloc[first].tolist()
    size = np.fromiter(map(len, text), dtype=np.int64, count=len(text))
    bands = line_hashes(["\n".join(text)], WordHasher())[4].reshape(len(text), BANDS, WIDTH)
    keys = np.zeros((len(text), BANDS, 8), dtype=np.uint8)
    keys[:, :, :WIDTH] = bands
    keys = keys.view(np.uint64)[:, :, 0]
    forest, counts, left, group = Forest(len(rid)), pair_counts(text, size), [], rid
    if "root" in pdf.columns:
        group = pdf["root"].to_numpy()[first]
        order = np.argsort(group, kind="stable")
        for k in np.flatnonzero(group[order][1:] == group[order][:-1]).tolist():
            forest.join(int(order[k]), int(order[k + 1]))
    for i, j in group_pairs(bounds):
        guest = (half[i] == GUEST) | (half[j] == GUEST)
        own, at, i, j = own_pairs(half, i, j), band[i], node[i], node[j]
        longest = np.maximum(size[i], size[j])
        limit = ((1 - similarity) * longest + 1e-9).astype(np.int64)
        near = np.flatnonzero(own & (longest - np.minimum(size[i], size[j]) <= limit))
        i, j, limit, guest, at = i[near], j[near], limit[near], guest[near], at[near]
        # a pair is looked at in the first band it meets in, but for guests: which blocks they visit differs by band
        near = (np.argmax(keys[i] == keys[j], axis=1) == at) | guest
        i, j, limit = i[near], j[near], limit[near]
        near = may_be_within(counts, i, j, limit)
        i, j, limit = i[near], j[near], limit[near]
        open_ = np.zeros(len(i), dtype=bool)
        for k, (p, q, most) in enumerate(zip(i.tolist(), j.tolist(), limit.tolist(), strict=True)):
            if forest.find(p) != forest.find(q):
                if cost_at_most(text[p], text[q], most) <= most:
                    forest.join(p, q)
                else:
                    open_[k] = True
        left.append((i[open_], j[open_], limit[open_]))
    if left:
        i, j, limit = map(np.concatenate, zip(*left, strict=True))
        apart = np.fromiter((forest.find(p) != forest.find(q) for p, q in zip(i.tolist(), j.tolist(), strict=True)), dtype=bool, count=len(i))
        i, j, limit = i[apart], j[apart], limit[apart]
        near = halves_may_be_within(text, size, i, j, limit)  # the dearest bound, so only for pairs not joined by others
        if near.any():
            undecided.add(rid, text, i[near], j[near], limit[near], forest, group)
    return _between(forest, rid, group)


def bytes_of(name: str, values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, dtype=KINDS[name]).tobytes()


def column(pdf: pd.DataFrame, name: str) -> np.ndarray:
    """The values of a column of byte strings, one row's after the other's."""
    return np.frombuffer(b"".join(pdf[name]), dtype=KINDS[name])


def line_pieces(base: int, known: np.ndarray, ids: np.ndarray, th: np.ndarray, line: np.ndarray, words: np.ndarray, h: np.ndarray, bands: np.ndarray, min_words: int) -> pd.DataFrame:
    """Lines of one task, numbered from ``base`` on, in byte strings: a row of own = 1 with all lines, and one for each range of digests
    with the distinct ones: digest, first occurrence (known, id, th, line, at: its number less base), count n, and keys of bands if has.
    local names a line's place among the distinct, which are sorted by digest; a range's begin at start."""
    order = np.lexsort((th, line, ids, known, h[:, 1], h[:, 0]))
    new = np.r_[True, (h[order][1:] != h[order][:-1]).any(1)]
    first, n = order[new], np.diff(np.r_[np.flatnonzero(new), len(order)])
    local = np.empty(len(order), dtype=np.int32)
    local[order] = np.cumsum(new) - 1
    rows = [{"own": 1, "part": -1, "chunk": base, "start": 0, "known": bytes_of("known", known), "id": bytes_of("id", ids), "th": bytes_of("th", th), "line": bytes_of("line", line), "words": bytes_of("words", words), "local": bytes_of("local", local)}]
    h, has = h[first], words[first] >= min_words
    part = (h[:, 0] // np.uint64((1 << 64) // RANGES)).astype(np.int64)
    values = {"known": known[first], "id": ids[first], "th": th[first], "line": line[first], "h": h, "n": n, "at": first, "has": has}
    bands, before = bands[first[has]], np.r_[0, np.cumsum(has)]
    cut = group_bounds(part)
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        row = {"own": 0, "part": int(part[lo]), "chunk": base, "start": lo} | {k: bytes_of(k, v[lo:hi]) for k, v in values.items()}
        rows.append(row | {"bands": bytes_of("bands", bands[before[lo] : before[hi]])})
    return pd.DataFrame(rows, columns=["part", "chunk", "start", *KINDS, "own"])


def distinct_lines(pdf: pd.DataFrame):
    """For each range of digests (part) a row with its distinct lines of all chunks: first occurrence (at in its chunk ``from``), count,
    keys of bands; and for the reply, chunk by chunk (chunks, start, many), the place of each of the chunk's lines (local). A line's rid
    is its place, and the range from 32 bits on."""
    cut = group_bounds(pdf["part"].to_numpy())
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        some = pdf.iloc[lo:hi]
        h, known, ids, th, line, at, n, has = (column(some, k) for k in ("h", "known", "id", "th", "line", "at", "n", "has"))
        h, many = h.reshape(-1, 2), some["known"].str.len().to_numpy()
        chunk = np.repeat(some["chunk"].to_numpy(), many)
        order = np.lexsort((chunk + at, th, line, ids, known, h[:, 1], h[:, 0]))
        new = np.r_[True, (h[order][1:] != h[order][:-1]).any(1)]
        first = order[new]
        local = np.empty(len(order), dtype=np.int32)
        local[order] = np.cumsum(new) - 1
        bands = column(some, "bands").reshape(-1, BANDS * WIDTH)[(np.cumsum(has) - 1)[first[has[first] > 0]]]
        values = {"known": known[first], "id": ids[first], "th": th[first], "line": line[first], "n": np.add.reduceat(n[order], np.flatnonzero(new)), "at": at[first], "has": has[first], "bands": bands, "local": local}
        row = {"part": some["part"].iloc[0], "lines": int(has[first].sum())} | {k: bytes_of(k, v) for k, v in values.items()}
        row |= {"from": bytes_of("id", chunk[first]), "chunks": bytes_of("id", some["chunk"]), "start": bytes_of("at", some["start"]), "many": bytes_of("at", many)}
        yield pd.DataFrame([row])


DISTINCT = "part long, lines long, known binary, id binary, th binary, line binary, n binary, at binary, has binary, bands binary, local binary, from binary, chunks binary, start binary, many binary"


def picked(frames, columns: list[str], fields: list[str]):
    """For rows of distinct_lines with a list ``picks`` of structs (rid and ``fields``): (rid, fields and ``columns`` of the lines)."""
    for pdf in frames:
        for _, row in pdf.iterrows():
            rid = np.array([x["rid"] for x in row["picks"]], dtype=np.int64)
            out = {"rid": rid} | {f: [x[f] for x in row["picks"]] for f in fields}
            yield pd.DataFrame(out | {c: np.frombuffer(row[c], dtype=KINDS["id" if c == "from" else c])[rid & 0xFFFFFFFF] for c in columns}).astype({"known": bool})


def spot_places(th: np.ndarray, line: np.ndarray, size: int) -> np.ndarray:
    """The bits, of 8 * ``size``, of lines of texts."""
    with np.errstate(over="ignore"):
        return mix64(th.astype(np.int64).view(np.uint64) + mix64(line.astype(np.uint64) + np.uint64(1))) & np.uint64(8 * size - 1)


def spot_bits(spots: DataFrame, most: int = 1 << 24):
    """A broadcast bit table of the lines (th, line), about a bit in 32 set, of at most ``most`` bytes; its slots of 8 KB are filled by tasks."""
    size = 1 << min(most.bit_length() - 1, max(13, (4 * spots.count()).bit_length()))

    def slots(frames):
        for pdf in frames:
            place = np.unique(spot_places(pdf["th"].to_numpy(), pdf["line"].to_numpy(), size))
            slot, low = (place >> np.uint64(16)).astype(np.int32), place.astype(np.uint16)
            cut = group_bounds(slot)
            yield pd.DataFrame({"slot": slot[cut[:-1]], "low": [low[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]})

    def filled(pdf):
        cut = group_bounds(pdf["slot"].to_numpy())
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            bits = np.zeros(1 << 16, dtype=np.uint8)
            bits[np.frombuffer(b"".join(pdf["low"].iloc[lo:hi]), dtype=np.uint16)] = 1
            yield pd.DataFrame({"slot": [pdf["slot"].iloc[lo]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    table = np.zeros((size >> 13, 1 << 13), dtype=np.uint8)
    for row in map_whole_groups(spots.select("th", "line").mapInPandas(slots, "slot int, low binary"), "slot", filled, "slot int, bits binary", 1).collect():
        table[row["slot"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return spots.sparkSession.sparkContext.broadcast(table.tobytes())


def lines_at(pdf: pd.DataFrame, bits: bytes) -> pd.DataFrame:
    """The normalised lines (known, id, th, line, text) of texts that are in the bit table, others by chance."""
    table, texts = np.frombuffer(bits, dtype=np.uint8), pdf["text"].tolist()
    many = np.fromiter((t.count("\n") + 1 for t in texts), dtype=np.int64, count=len(texts))
    owner = np.repeat(np.arange(len(texts)), many)
    line = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    place = spot_places(pdf["th"].to_numpy()[owner], line, len(table))
    hit = np.flatnonzero(table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
    owner, line, found, last = owner[hit], line[hit], [], -1
    for k, n in zip(owner.tolist(), line.tolist(), strict=True):
        if k != last:
            own, last = texts[k].split("\n"), k
        found.append(normalised(own[n]))
    return pd.DataFrame({c: pdf[c].to_numpy()[owner] for c in ("known", "id", "th")} | {"line": line.astype(np.int32), "text": found})


def replies(frames):
    """For rows of distinct_lines with ``picks`` (rid, keep: known, id, line, row, and lines of the line's group) of the lines that are near others:
    for each chunk, in byte strings, what its lines (local) of groups of two lines or more have to know."""
    for pdf in frames:
        for _, row in pdf.iterrows():
            get = lambda name, kind=None: np.frombuffer(row[name], dtype=KINDS[kind or name])  # noqa: E731, B023
            keep = {"known": get("known").copy(), "id": get("id").copy(), "line": get("line").copy(), "row": get("from", "id") + get("at"), "n": get("n").copy()}
            if row["picks"] is not None and len(row["picks"]):
                where = np.array([x["rid"] for x in row["picks"]], dtype=np.int64) & 0xFFFFFFFF
                for name, source in (("known", "known"), ("id", "id"), ("line", "line"), ("row", "row"), ("n", "lines")):
                    keep[name][where] = [x[source] for x in row["picks"]]
            local, many, begin = get("local"), get("many", "at"), get("start", "at")
            cut = np.r_[0, np.cumsum(many)]
            out = []
            for chunk, start, lo, hi in zip(get("chunks", "id").tolist(), begin.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                here = local[lo:hi]
                more = np.flatnonzero(keep["n"][here] > 1)
                if len(more):
                    to = here[more]
                    out.append({"chunk": chunk, "local": bytes_of("local", start + more), "keep_known": bytes_of("known", keep["known"][to]), "keep_id": bytes_of("id", keep["id"][to]), "keep_line": bytes_of("line", keep["line"][to]), "keep_row": bytes_of("id", keep["row"][to]), "lines": bytes_of("n", keep["n"][to])})
            if out:
                yield pd.DataFrame(out)


def answered(pdf: pd.DataFrame, rows: int = 1 << 15):
    """The lines of whole chunks, one row each, from their rows of line_pieces and replies; without a reply a line is a group of its own."""
    cut = group_bounds(pdf["chunk"].to_numpy())
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        some = pdf.iloc[lo:hi]
        own, told = some[some["words"].notna()], some[some["words"].isna()]
        known, ids, th, line, words, local = (column(own, k) for k in ("known", "id", "th", "line", "words", "local"))
        row = int(own["chunk"].iloc[0]) + np.arange(len(local))
        at = np.full(int(local.max()) + 1, -1)
        to = column(told, "local")
        at[to] = np.arange(len(to))
        at = at[local]
        joined = lambda name, kind: np.r_[np.frombuffer(b"".join(told[name]), dtype=KINDS[kind]), np.zeros(1, KINDS[kind])][at]  # noqa: E731, B023
        alone = at < 0
        out = pd.DataFrame({
            "known": known > 0, "id": ids, "th": th, "line": line, "words": words,
            "keep_known": np.where(alone, known, joined("keep_known", "known")) > 0, "keep_id": np.where(alone, ids, joined("keep_id", "id")),
            "keep_line": np.where(alone, line, joined("keep_line", "line")), "lines": np.where(alone, 1, joined("lines", "n")),
            "kept": alone | (joined("keep_row", "id") == row),
        })
        for a in range(0, len(out), rows):
            yield out.iloc[a : a + rows]


def key_blobs(distinct: DataFrame, held: int = 1 << 17) -> DataFrame:
    """The band keys (40 bits and the band) and rids of all lines in byte strings, dealt by ranges of the keys: a row for a part's keys
    of up to ``held`` lines, so that not every key is a row. Bytes that a part's keys or neighbouring lines have in common lie together."""
    lines = distinct.agg(F.sum("lines")).first()[0] or 0
    parts = min(1 << 12, max(1 << 4, lines * BANDS >> 16))

    def blobs(rid: np.ndarray, bands: np.ndarray) -> pd.DataFrame:
        key = np.zeros((len(rid), BANDS, 8), dtype=np.uint8)
        key[:, :, :WIDTH] = bands.reshape(len(rid), BANDS, WIDTH)
        key[:, :, WIDTH] = np.arange(BANDS)
        key, rid = key.view("<u8").reshape(-1), np.repeat(rid.view(np.uint64), BANDS)
        part = ((key >> np.uint64(8) & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        key, rid, cut = key[order], rid[order], group_bounds(part[order])
        columns = {"low": key.astype(np.uint32), "top": (key >> np.uint64(32)).astype(np.uint8), "band": (key >> np.uint64(40)).astype(np.uint8)}
        columns |= {"rid_0": rid.astype(np.uint16), "rid_16": (rid >> np.uint64(16)).astype(np.uint16), "rid_high": (rid >> np.uint64(32)).astype(np.uint32)}
        return pd.DataFrame({"part": part[order][cut[:-1]].astype(np.int32)} | {k: [v[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)] for k, v in columns.items()})

    def pack(frames):
        rid, bands, n = [], [], 0
        for pdf in frames:
            for part, has, keys in zip(pdf["part"], pdf["has"], pdf["bands"], strict=True):
                rid.append((int(part) << 32) + np.flatnonzero(np.frombuffer(has, dtype=np.uint8)))
                bands.append(np.frombuffer(keys, dtype=np.uint8))
                n += len(rid[-1])
                if n >= held:
                    yield blobs(np.concatenate(rid), np.concatenate(bands))
                    rid, bands, n = [], [], 0
        if n:
            yield blobs(np.concatenate(rid), np.concatenate(bands))

    return distinct.select("part", "has", "bands").mapInPandas(pack, "part int, low binary, top binary, band binary, rid_0 binary, rid_16 binary, rid_high binary")


def whole_keys(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of key_blobs as one of bucket_rows."""
    joined = lambda name, kind: np.frombuffer(b"".join(pdf[name]), dtype=kind)
    high = joined("top", "u1") | joined("band", "u1").astype(np.uint16) << np.uint16(8)
    low = joined("rid_0", "<u2") | joined("rid_16", "<u2").astype(np.uint32) << np.uint32(16)
    return pd.DataFrame([{"key_low": b"".join(pdf["low"]), "key_high": high.tobytes(), "rid_low": low.tobytes(), "rid_high": b"".join(pdf["rid_high"])}])


def bucket_rows(pdf: pd.DataFrame, limit: int) -> pd.DataFrame:
    """Units (unit, half, rid, band, key) of the buckets of two lines or more in rows of whole_keys that hold whole buckets.

    A bucket of at most ``limit`` lines is one unit, named after its members, so that those of several bands with the same members
    are one; the name begins with FAMILY bits of the least, so that units of like members come to one task, side by side. A larger one is dealt into blocks by hash, each with the bucket's ANCHORS as guests, so that most near lines are joined by
    rows that grow with the bucket, not with its square; the rest of its pairs is left to cross_rows. key is -1 where none are left."""
    joined = lambda name, kind: np.frombuffer(b"".join(pdf[name]), dtype=kind).astype(np.uint64)
    key = joined("key_high", "<u2") << np.uint64(32) | joined("key_low", "<u4")
    rid = joined("rid_high", "<u4") << np.uint64(32) | joined("rid_low", "<u4")
    order = np.argsort(key, kind="stable")
    key, rid = key[order], rid[order]
    bounds = group_bounds(key)
    size = np.diff(bounds)
    each = np.repeat(size, size)
    few = (each >= 2) & (each <= limit)
    out = []
    with np.errstate(over="ignore"):
        if few.any():
            k, r = key[few], rid[few]
            cut = group_bounds(k)
            rest = np.uint64(64 - FAMILY)
            name = mix64(np.minimum.reduceat(r, cut[:-1])) >> rest << rest | mix64(np.add.reduceat(mix64(mix64(r)), cut[:-1])) >> np.uint64(FAMILY)
            out.append((np.repeat(name, np.diff(cut)), np.zeros(len(r), np.int32), r, k, np.full(len(r), -1, np.int64)))
        for lo, hi in zip(bounds[:-1][size > limit], bounds[1:][size > limit], strict=True):
            r, blocks = rid[lo:hi], -(-(hi - lo) // limit)
            spread = mix64(r ^ np.uint64(0x9E3779B97F4A7C15))
            block = (spread % np.uint64(blocks)).astype(np.int64)
            anchors = np.argsort(spread, kind="stable")[:ANCHORS]
            guest, at = np.repeat(anchors, blocks), np.tile(np.arange(blocks), len(anchors))
            guest, at = guest[block[guest] != at], at[block[guest] != at]
            half = np.r_[np.zeros(len(r), np.int32), np.full(len(guest), GUEST, np.int32)]
            name = mix64(mix64(key[lo : lo + 1]) + np.r_[block, at].astype(np.uint64))
            rows = np.r_[r, r[guest]]
            out.append((name, half, rows, np.full(len(rows), key[lo]), np.full(len(rows), int(key[lo]), np.int64)))
    if not out:
        return pd.DataFrame({"unit": [], "half": [], "rid": [], "band": [], "key": []}).astype("int64")
    unit, half, rid, key, large = map(np.concatenate, zip(*out, strict=True))
    return pd.DataFrame({"unit": unit.view(np.int64), "half": half, "rid": rid.view(np.int64), "band": (key >> np.uint64(8 * WIDTH)).astype(np.int32), "key": large})


def cross_rows(pdf: pd.DataFrame, limit: int, similarity: float, rows: int = 1 << 17):
    """Units (unit, half, rid, band, root) of whole buckets (key, rid, band, root, size) in which all pairs of lines meet that are of
    different roots and not too unlike in length (size) to be near. Blocks of ``limit`` lines are cut in the order of length, large
    roots apart; two blocks of one and the same root don't meet, nor do blocks of which all lines are too unlike in length."""
    rid, root, band, key = (pdf[c].to_numpy() for c in ("rid", "root", "band", "key"))
    size = pdf["size"].to_numpy()
    held, n = [], 0
    bounds = group_bounds(key)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        _, own, count = np.unique(root[lo:hi], return_inverse=True, return_counts=True)
        apart = np.where(count[own] > limit // 2, own, len(count))
        order = np.lexsort((rid[lo:hi], size[lo:hi], apart))
        own, apart, long = own[order], apart[order], size[lo:hi][order]
        starts, at = [], 0
        while at < len(own):
            starts.append(at)
            at = min(at + limit, int(np.searchsorted(apart, apart[at], "right")))
        ends = [*starts[1:], len(own)]
        pure = [int(own[a]) if (own[a:b] == own[a]).all() else -1 for a, b in zip(starts, ends, strict=True)]
        member = lo + order
        for x in range(len(starts)):
            for y in range(x, len(starts)):
                if pure[x] >= 0 and pure[x] == pure[y]:
                    continue
                shorter, longer = sorted((x, y), key=lambda k: long[starts[k]])
                if similarity * long[starts[longer]] - 1e-6 > long[ends[shorter] - 1]:
                    continue
                one, two = member[starts[x] : ends[x]], member[starts[y] : ends[y]] if y > x else member[:0]
                who = np.r_[one, two]
                with np.errstate(over="ignore"):
                    name = mix64(mix64(key[lo : lo + 1].view(np.uint64)) + np.uint64(x << 32 | y)).view(np.int64)
                half = np.r_[np.full(len(one), int(y > x), np.int32), np.full(len(two), 2, np.int32)]
                held.append(pd.DataFrame({"unit": np.repeat(name, len(who)), "half": half, "rid": rid[who], "band": band[who], "root": root[who]}))
                n += len(who)
                if n >= rows:
                    yield pd.concat(held)
                    held, n = [], 0
    if held:
        yield pd.concat(held)


def near_lines(docs: DataFrame, similarity: float = 0.8, min_words: int = 5, block: int = 300, short: bool = False) -> DataFrame:
    """One row per line of ``min_words`` words or more: key, text_hash, line_no (from 0), n_words, keep_key, keep_line_no, n_lines, kept.

    keep_* name the first occurrence (by id, line) of the line's group, n_lines counts the group's lines; kept marks that
    occurrence, one row of the group. Lines are parted by line feeds. A null text has no lines; null ids sort first; of repeated rows
    one holds the occurrence. ``short``: lines of 1 to ``min_words`` - 1 words have rows, too, and are grouped where they are equal
    once normalised.
    """
    own = docs.select(spot().alias("key"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    flat = own.select("key.known", "key.id", "th", "text")

    def lines_of(frames):
        from pyspark import TaskContext

        hasher, base, held, n = WordHasher(), TaskContext.get().partitionId() << 36, [], 0
        for pdf in frames:
            texts, known, ids, ths = pdf["text"].tolist(), pdf["known"].to_numpy(), pdf["id"].to_numpy(), pdf["th"].to_numpy()
            for lo, hi in text_groups(texts):
                text, number, words, digests, bands = line_hashes(texts[lo:hi], hasher)
                k = np.flatnonzero(words >= (1 if short else min_words))
                if not len(k):
                    continue
                at, digests = text[k] + lo, np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
                held.append((known[at], ids[at], ths[at], number[k], words[k], digests[k], bands[k]))
                n += len(k)
                if n >= HELD:
                    yield line_pieces(base, *map(np.concatenate, zip(*held, strict=True)), min_words)
                    base, held, n = base + n, [], 0
        if n:
            yield line_pieces(base, *map(np.concatenate, zip(*held, strict=True)), min_words)

    pieces = flat.mapInPandas(lines_of, "part long, chunk long, start int, " + "".join(f"{k} binary, " for k in KINDS) + "own int")
    lines, dealt = materialize_by(pieces, "own", (1, 0), "zstd")
    found_in = dealt.drop("words", "local")
    distinct = materialize(map_whole_groups(found_in, "part", distinct_lines, DISTINCT, 1), "zstd")
    drop_scratch(dealt)
    release_shuffles(docs.sparkSession)

    def deal(pdf: pd.DataFrame):
        yield bucket_rows(whole_keys(pdf), block)

    met = map_whole_groups(key_blobs(distinct), "part", deal, "unit long, half int, rid long, band int, key long", 1)
    named_units = materialize(met.groupBy("unit", "half", "rid").agg(F.min("band").alias("band"), F.max("key").alias("key")))
    release_shuffles(docs.sparkSession)

    def picks(rids: DataFrame, columns: list[str], *fields: str) -> DataFrame:
        """Rows of the wanted lines of ``distinct`` with their rids."""
        by_part = rids.groupBy(F.shiftright("rid", 32).alias("part")).agg(F.collect_list(F.struct("rid", *fields)).alias("picks"))
        kinds = {"known": "boolean", "line": "int", "at": "int"}
        schema = ", ".join(["rid long", *(f"{f} long" for f in fields), *(f"`{c}` {kinds.get(c, 'long')}" for c in columns)])
        return by_part.join(distinct.select("part", *columns), "part").mapInPandas(lambda frames: picked(frames, columns, list(fields)), schema)

    spots = materialize(picks(named_units.select("rid").distinct(), ["known", "id", "th", "line"]), "zstd")
    # bit tables of bounded size: most texts without wanted lines don't come to Python, most other lines aren't shuffled
    bit = F.pmod("th", F.lit(BITS))
    some = spots.select(bit.alias("_bit")).distinct()
    bits = spot_bits(spots)

    def cut(frames):
        for pdf in frames:
            yield lines_at(pdf, bits.value)

    texts = flat.withColumn("_bit", bit).join(F.broadcast(some), "_bit", "left_semi").drop("_bit")
    found_lines = texts.mapInPandas(cut, "known boolean, id long, th long, line int, text string").join(spots, ["known", "id", "th", "line"])
    wanted_lines = materialize(found_lines.select("rid", "text").dropDuplicates(["rid"]), "zstd")
    bits.unpersist()
    release_shuffles(docs.sparkSession)

    def verify(frames):
        yield from near_edges(frames, similarity)

    def links(units: DataFrame) -> DataFrame:
        return units.join(wanted_lines, "rid").repartition(F.shiftright("unit", 64 - FAMILY)).sortWithinPartitions("unit").mapInPandas(verify, "a long, b long")

    scratch = [distinct, named_units, spots, wanted_lines]  # nothing reads them once there are classes
    roots = components(links(named_units.drop("key")))
    members = named_units.where((F.col("key") >= 0) & (F.col("half") != GUEST)).select("key", "rid", "band")
    if not members.isEmpty():  # large buckets: pairs of their lines that are not joined yet and were in no common block
        sized = members.join(wanted_lines.select("rid", F.char_length("text").alias("size")), "rid")
        placed = sized.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
        cross = materialize(map_whole_groups(placed, "key", lambda pdf: cross_rows(pdf, block, similarity), "unit long, half int, rid long, band int, root long"))
        scratch.append(cross)
        further = components(links(cross)).select(F.col("node").alias("root"), F.col("root").alias("least"))
        # a line without a link in its blocks is its own root
        every = roots.unionByName(further.select(F.col("root").alias("node"), "root").join(roots.select("node"), "node", "left_anti"))
        roots = every.join(further, "root", "left").select("node", F.coalesce("least", "root").alias("root"))
    linked = picks(roots.select(F.col("node").alias("rid"), "root"), ["known", "id", "th", "line", "at", "from", "n"], "root")
    linked = materialize(linked.select("rid", "root", F.struct("known", "id", "line", "th", (F.col("from") + F.col("at")).alias("row")).alias("first"), "n"))
    kept = linked.groupBy("root").agg(F.min("first").alias("keep"), F.sum("n").alias("lines"))
    told = linked.select("rid", "root").join(kept, "root").select(F.shiftright("rid", 32).alias("part"), F.struct("rid", "keep.known", "keep.id", "keep.line", "keep.row", "lines").alias("pick"))
    asked = distinct.drop("lines", "has", "bands", "th").join(told.groupBy("part").agg(F.collect_list("pick").alias("picks")), "part", "left")
    answers = materialize(asked.mapInPandas(replies, "chunk long, local binary, keep_known binary, keep_id binary, keep_line binary, keep_row binary, lines binary"), "zstd")
    drop_scratch(*scratch, linked, roots)
    release_shuffles(docs.sparkSession)
    both = lines.select("chunk", "known", "id", "th", "line", "words", "local").unionByName(answers, allowMissingColumns=True)
    found = map_whole_groups(both, "chunk", answered, "known boolean, id long, th long, line int, words int, keep_known boolean, keep_id long, keep_line int, lines long, kept boolean", 1)
    return found.select(
        F.struct("known", "id").alias("key"),
        F.col("th").alias("text_hash"),
        F.col("line").alias("line_no"),
        F.col("words").alias("n_words"),
        F.struct(F.col("keep_known").alias("known"), F.col("keep_id").alias("id")).alias("keep_key"),
        F.col("keep_line").alias("keep_line_no"),
        F.col("lines").alias("n_lines"),
        "kept",
    )


def report(docs: DataFrame, **parameters) -> DataFrame:
    """near_lines with ids: doc_id, line_no, n_words, keep_doc_id, keep_line_no, n_lines, kept."""
    found = near_lines(docs, **parameters)
    return found.select(from_spot(F.col("key")).alias("doc_id"), "line_no", "n_words", from_spot(F.col("keep_key")).alias("keep_doc_id"), "keep_line_no", "n_lines", "kept")


def without_repeats(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with the lines that near_lines doesn't keep taken out of text, and n_chars, if there is such a column, counted anew.
    A document goes if it loses lines and nothing but white space is left; documents that lose no line stay as they are. Of rows
    that repeat id and text one keeps the kept lines."""
    found = near_lines(docs, **parameters)
    marks = found.groupBy(F.col("key").alias("_tl_key"), F.col("text_hash").alias("_tl_th")).agg(F.collect_set("line_no").alias("_tl_all"), F.collect_set(F.when(F.col("kept"), F.col("line_no"))).alias("_tl_kept"))
    keyed = docs.withColumn("_tl_key", spot()).withColumn("_tl_th", F.xxhash64(F.coalesce("text", F.lit(""))))
    turn = F.row_number().over(Window.partitionBy("_tl_key", "_tl_th").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
    drop = F.when(F.col("_tl_turn") == 1, F.array_except("_tl_all", "_tl_kept")).otherwise(F.col("_tl_all"))
    joined = keyed.withColumn("_tl_turn", turn).join(marks, ["_tl_key", "_tl_th"], "left").withColumn("_tl_drop", drop)
    rest = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("_tl_drop", i)), "\n")
    out = joined.withColumn("text", F.when(F.size("_tl_drop") > 0, rest).otherwise(F.col("text")))
    out = out.where(F.col("_tl_drop").isNull() | (F.size("_tl_drop") == 0) | F.col("text").rlike(r"(?U)\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_tl_drop") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
