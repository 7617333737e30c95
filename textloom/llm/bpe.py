"""Byte-level BPE over a shuffle of distinct words.

Documents are split into pre-tokens in chunks; a chunk's table row keeps, in order of position, which of its distinct words stands
there. The distinct words of all chunks, one row for each chunk that has the word, are shuffled by word, so that each word is encoded
once. The ids go back to the chunks, packed, where documents are put together by position and decoded through the table of token
bytes, of which every task holds the whole (one row per token of the file). Frequent words cost no more than rare ones, and
positions never leave their chunk.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import from_key, id_key, repeatable


def rank_table(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


def encoder(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("textloom", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class ByteTable:
    """Byte strings by number, gathered for many numbers at once."""

    def __init__(self, data: np.ndarray, length: np.ndarray, start: np.ndarray):
        self.data, self.length, self.start = data, length, start

    @classmethod
    def of(cls, values: list[bytes]) -> ByteTable:
        length = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
        return cls(np.frombuffer(b"".join(values), dtype=np.uint8), length, np.cumsum(length) - length)

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        length = self.length[numbers]
        ends = np.cumsum(length)
        if not len(ends) or not ends[-1]:
            return np.zeros(0, dtype=np.uint8)
        return self.data[np.repeat(self.start[numbers] - (ends - length), length) + np.arange(ends[-1])]


def token_bytes(ranks: dict[bytes, int]) -> ByteTable:
    by_id = dict(zip(ranks.values(), ranks, strict=True))
    return ByteTable.of([by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)])


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers, each stored plane by plane and compressed."""
    import zstandard

    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a, dtype=np.uint32)
        width = 1 if not len(a) or a.max() < 1 << 8 else 2 if a.max() < 1 << 16 else 3 if a.max() < 1 << 24 else 4
        planes = zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 4)[:, :width].T).tobytes(), 1)
        parts.append(np.array([len(a), width, len(planes)], dtype=np.uint32).tobytes() + planes)
    return b"".join(parts)


def _unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    out, at = [], 0
    while at < len(data):
        n, width, size = (int(x) for x in np.frombuffer(data[at : at + 12], dtype=np.uint32))
        planes = np.frombuffer(zstandard.decompress(data[at + 12 : at + 12 + size]), dtype=np.uint8).reshape(width, n)
        a = np.zeros((n, 4), dtype=np.uint8)
        a[:, :width] = planes.T
        out.append(a.view(np.uint32).reshape(-1))
        at += 12 + size
    return out


def _chunks(frames, pattern: str, size: int):
    """A row for each chunk of about ``size`` characters: its number, the keys and pre-token counts of its documents, its distinct
    words, the commonest first, and for each pre-token the place of its word among them."""
    import regex

    split = regex.compile(pattern).findall
    partition, chunk = 0, 0
    keys: list[str | None] = []
    positions: list[np.ndarray] = []
    held = 0

    def rank():
        ranks = defaultdict()
        ranks.default_factory = ranks.__len__
        return ranks

    ranks = rank()

    def frame():
        flat = np.concatenate(positions)
        order = np.argsort(-np.bincount(flat, minlength=len(ranks)), kind="stable")  # so that most places are small numbers
        words, place = list(ranks), np.empty(len(ranks), dtype=np.uint32)
        place[order] = np.arange(len(ranks))
        lengths = np.fromiter(map(len, positions), dtype=np.uint32, count=len(positions))
        row = ((partition << 14) + chunk, keys, _pack(place[flat], lengths), [words[k].encode("utf-8", "surrogatepass") for k in order.tolist()])
        return pd.DataFrame([row], columns=["chunk", "keys", "places", "words"])

    for pdf in frames:
        for partition, key, text in zip(pdf["part"].tolist(), pdf["key"].tolist(), pdf["text"].tolist(), strict=True):
            keys.append(key)
            positions.append(np.fromiter(map(ranks.__getitem__, split(text)), dtype=np.uint32))
            held += len(text)
            if held >= size:
                yield frame()
                keys, positions, held, ranks, chunk = [], [], 0, rank(), chunk + 1
    if keys:
        yield frame()


#: Bits of a word's place in the number of (chunk, place).
PLACE = 28


def encode_words(words: DataFrame, ranks_path: str, pattern: str, held: int = 1 << 18) -> DataFrame:
    """(chunk, answers) for rows (place, word) of the distinct words of chunks, place being the chunk's number and, in the last PLACE
    bits, the word's place: for each chunk packed answers, which hold steps from place to place, id counts and ids of some of its
    words. About ``held`` words are gathered before answers are sent."""

    def run(frames):
        single = encoder(rank_table(ranks_path), pattern)._encode_single_piece
        last, ids, places, lists = None, [], [], []

        def answers():
            place, count = np.concatenate(places), np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
            flat, first = np.fromiter((i for x in lists for i in x), dtype=np.int64, count=int(count.sum())), np.cumsum(count) - count
            order, out = np.argsort(place), []
            chunk = place[order] >> PLACE
            bounds = np.r_[0, np.flatnonzero(chunk[1:] != chunk[:-1]) + 1, len(chunk)]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                own = order[lo:hi]
                at, c = place[own] & ((1 << PLACE) - 1), count[own]
                stop = np.cumsum(c)
                out.append((chunk[lo], _pack(np.diff(at, prepend=0), c, flat[np.repeat(first[own] - (stop - c), c) + np.arange(stop[-1])])))
            return pd.DataFrame(out, columns=["chunk", "answers"])

        for pdf in frames:
            places.append(pdf["place"].to_numpy())
            for word in pdf["word"].tolist():
                if word != last:
                    last, ids = word, single(bytes(word))
                lists.append(ids)
            if len(lists) >= held:
                yield answers()
                places, lists = [], []
        if lists:
            yield answers()

    return words.repartition("word").sortWithinPartitions("word").mapInPandas(run, "chunk long, answers binary")


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, chunk_chars: int = 24 << 20, render=None, schema: str = "ids array<int>, decoded binary") -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id and what ``render(ids, decoded)`` gives, by default the ids and the bytes
    they decode to. A null text is empty (no ids); null ids and repeated rows come back as they are.

    Texts are split twice, once for their words and once for the places, which is less than keeping the places would write.
    ranks_path names a file of base64 token and rank lines that workers can read. A document of any length is whole in one chunk.
    """
    own = docs.select(id_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = repeatable(own).withColumn("part", F.spark_partition_id())  # the same in both readings
    chunks = numbered.mapInPandas(lambda frames: _chunks(frames, pattern, chunk_chars), "chunk long, keys array<string>, places binary, words array<binary>")
    words = chunks.select("chunk", F.posexplode_outer("words").alias("at", "word")).where("word is not null").select((F.shiftleft("chunk", PLACE) + F.col("at")).alias("place"), "word")
    back = encode_words(words, ranks_path, pattern)
    heads = chunks.select("chunk", F.lit(None).cast("binary").alias("answers"), "keys", "places")
    rows = back.withColumn("keys", F.lit(None).cast("array<string>")).withColumn("places", F.lit(None).cast("binary")).unionByName(heads)
    render = render or (lambda ids, decoded: (ids.tolist(), decoded.tobytes()))
    names = [c.strip().split()[0] for c in schema.split(",")]

    def whole(keys, places, answers: list[bytes], table: ByteTable):
        """The documents of a chunk."""
        at, lengths = _unpack(places)
        steps, count, ids = zip(*map(_unpack, answers), strict=True) if answers else ([], [], [])
        none = [np.zeros(0, dtype=np.int64)]
        where, count, ids = np.concatenate([*map(np.cumsum, steps), *none]), np.concatenate([*count, *none]).astype(np.int64), np.concatenate([*ids, *none]).astype(np.uint32)
        if len(where) != (int(at.max()) + 1 if len(at) else 0):
            raise RuntimeError("a chunk's words are missing or doubled")
        order = np.argsort(where)
        count, first = count[order], (np.cumsum(count) - count)[order]
        out, start = [], 0
        for key, n in zip(keys, lengths.tolist(), strict=True):
            here = at[start : start + n].astype(np.int64)
            c, f = count[here], first[here]
            start += n
            stop = np.cumsum(c)
            own = ids[np.repeat(f - (stop - c), c) + np.arange(stop[-1])] if n else ids[:0]
            out.append((key, *render(own, table(own))))
        return pd.DataFrame(out, columns=["key", *names])

    def assemble(frames):
        """Rows sorted by chunk, a chunk's own row first; what is held is one chunk."""
        table = token_bytes(rank_table(ranks_path))
        now, keys, places, answers = None, None, None, []
        for pdf in frames:
            for chunk, answer, own, at in zip(pdf["chunk"], pdf["answers"], pdf["keys"], pdf["places"], strict=True):
                if at is not None:
                    if now is not None:
                        yield whole(keys, places, answers, table)
                    now, keys, places, answers = chunk, own, at, []
                elif chunk != now:
                    raise RuntimeError("a chunk's documents are missing")
                else:
                    answers.append(answer)
        if now is not None:
            yield whole(keys, places, answers, table)

    made = rows.repartition("chunk").sortWithinPartitions("chunk", F.col("places").isNull()).mapInPandas(assemble, f"key string, {schema}")
    return made.select(from_key(F.col("key")).alias("doc_id"), *names)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by single spaces) and decoded_sha256 for every row."""
    held: list[ByteTable] = []

    def render(ids: np.ndarray, decoded: np.ndarray):
        if not held:
            held.append(ByteTable.of([b"%d " % i for i in range(1 << 17)]))
        return len(ids), hashlib.sha256(held[0](ids).tobytes()[:-1]).hexdigest(), hashlib.sha256(decoded.tobytes()).hexdigest()

    return encode_documents(docs, ranks_path, pattern, render=render, schema="n_tokens long, ids_sha256 string, decoded_sha256 string")
