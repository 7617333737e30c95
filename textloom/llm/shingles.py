"""Word shingles of many texts at once, as 64-bit hashes, with numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class WordHasher:
    """64-bit hashes of byte ranges (words), eight bytes at a time, each eight mixed into what came before by a bijection: words of
    one length of at most eight bytes never meet, and no pattern in texts makes others meet. Words of more than LONG bytes are
    hashed by blake2b."""

    LONG = 64
    MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the ranges start to end, none empty."""
        raw = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
        eights = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
        length = end - start
        with np.errstate(over="ignore"):
            out = mix64(length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
            out = mix64(out ^ (eights[start] & self.MASKS[np.minimum(length, 8)]))
            rest = np.flatnonzero(length > 8)
            for at in range(8, self.LONG, 8):
                if not len(rest):
                    break
                out[rest] = mix64(out[rest] ^ (eights[start[rest] + at] & self.MASKS[np.minimum(length[rest] - at, 8)]))
                rest = rest[length[rest] > at + 8]
        for k in rest:
            out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
        return out


def text_groups(texts: list[str], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` characters."""
    lo = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _words(texts: list[str], hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each text)."""
    data = np.frombuffer(("\n".join(" ".join(t.lower().split()) for t in texts) + "\n").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    stop = np.flatnonzero((data == 32) | (data == 10))
    start = np.r_[0, stop[:-1] + 1]
    line = np.r_[0, np.cumsum(data[stop] == 10)[:-1]]
    real = stop > start
    return hasher(data, start[real], stop[real]), np.bincount(line[real], minlength=len(texts))


def _spans(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, bounds) of the shingles of texts with so many words."""
    first = np.r_[0, np.cumsum(words)[:-1]]
    count = np.where(words == 0, 0, np.maximum(1, words - n + 1))
    bounds = np.r_[0, np.cumsum(count)]
    owner = np.repeat(np.arange(len(words)), count)
    return first[owner] + (np.arange(bounds[-1]) - bounds[owner]), np.minimum(words, n)[owner], bounds


def words_of(texts: list[str], hasher: WordHasher, n: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): hashes of the n-word shingles of each text, text i's being bounds[i]:bounds[i + 1].

    Words are the white-space-separated parts of the lower-cased text. A text of 1 to n - 1 words has one shingle, all of
    it; a text without words has none.
    """
    word, words = _words(texts, hasher)
    head, length, bounds = _spans(words, n)
    out = np.zeros(len(head), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            here = np.flatnonzero(length > k)
            out[here] = mix64(out[here] * np.uint64(0x9E3779B97F4A7C15) + word[head[here] + k])
    return out, bounds


def exact_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The set of n-word shingles of each text as sorted numbers, equal only where the shingles' words are."""
    names: dict[str, int] = {}
    split = [t.lower().split() for t in texts]
    word = np.fromiter((names.setdefault(w, len(names) + 1) for s in split for w in s), dtype=np.int64, count=sum(map(len, split)))
    head, length, bounds = _spans(np.fromiter(map(len, split), dtype=np.int64, count=len(split)), n)
    code = np.zeros(len(head), dtype=np.int64)
    for k in range(n):  # the code of the words so far and the next word, numbered anew
        there = length > k
        code = np.unique(code * (len(names) + 1) + np.where(there, word[np.where(there, head + k, 0)] if len(word) else 0, 0), return_inverse=True)[1]
    return [np.unique(code[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
