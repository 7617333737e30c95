"""Hierarchical multi-length packing.

A document's ids, with an end id, are cut into whole windows of the longest tier; what is left stays in one piece and is routed to the
shortest tier that holds it. Each tier is packed by best fit: pieces of the longest tier leave gaps that pieces of shorter tiers fill;
a shorter tier's sequences hold mixes that fill them exactly (so that, at a power of two, they need no padding); what fits no such mix
shares long windows. Which lengths go together is planned on the counts by length (at most as many as the longest window has ids),
then a piece finds its place by its rank among the pieces of its length. Step groups hold sequences of one size and the same number
of ids.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import from_key, id_key, materialize
from .sharding import with_rank

TIERS = (1024, 512, 256, 128)


def json_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a byte-level BPE tokenizer file: its ids, in the order of its merges, by bytes instead of printable stand-ins."""
    with open(path, encoding="utf-8") as lines:
        model = json.load(lines)
    added = {t["content"] for t in model.get("added_tokens", [])}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    return {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}


def added_tokens(path: str) -> dict[str, int]:
    """The file's added tokens, which are found in texts before anything else."""
    with open(path, encoding="utf-8") as lines:
        tokens = json.load(lines).get("added_tokens", [])
    if any(t.get(flag) for t in tokens for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that depend on what stands beside them")
    return {t["content"]: t["id"] for t in tokens}


def file_encoder(path: str, pattern: str):
    """text -> ids, as the tokenizers library has them without tokens around the text: added tokens in texts are found first, the
    longest of those that begin at a place, and the parts between them are encoded each for itself."""
    plain, added = encoder(json_ranks(path), pattern).encode_ordinary, added_tokens(path)
    if not added:
        return plain
    cut = re.compile("|".join(re.escape(t) for t in sorted(added, key=lambda t: (-len(t), t))))

    def encode(text: str) -> list[int]:
        ids, at = [], 0
        for m in cut.finditer(text):
            ids += plain(text[at : m.start()])
            ids.append(added[m[0]])
            at = m.end()
        return ids + plain(text[at:]) if ids else plain(text)

    return encode


def cuts(n: int, longest: int = TIERS[0]) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: whole windows, then the rest."""
    return [(at, min(longest, n - at)) for at in range(0, n, longest)]


def plan(counts: dict[int, int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, int, int, int, int, int, int]]:
    """Places for counts[length] pieces: (length, first rank, end rank, pieces in a sequence, first sequence, offset, filled).

    Rank r of a length, first <= r < end, goes to sequence first + (r - first rank) // pieces, at offset + its turn there times
    length. Best fit by decreasing length, done for all sequences of the same composition at once.
    """
    longest = tiers[0]
    left = {n: c for n, c in sorted(counts.items()) if c > 0}
    used = dict.fromkeys(left, 0)
    out, sequences = [], 0

    def place(mix: list[tuple[int, int]]):
        nonlocal sequences
        times = max(1, min(left[n] // k for n, k in mix))
        offset, filled = 0, sum(n * k for n, k in mix)
        for n, k in mix:
            out.append((n, used[n], used[n] + k * times, k, sequences, offset, filled))
            used[n] += k * times
            left[n] -= k * times
            offset += n * k
        sequences += times

    def mixed(head: int, room: int) -> tuple[list[tuple[int, int]], int]:
        """One piece of length ``head`` and the longest others that fit, and the gap that is left."""
        mix, gap = [(head, 1)], room - head
        for n in sorted(left, reverse=True):
            if n <= min(gap, head) and (k := min(gap // n, left[n] - (n == head))) > 0:
                if n == head:
                    mix[0] = (n, 1 + k)
                else:
                    mix.append((n, k))
                gap -= n * k
            if not gap:
                break
        return mix, gap

    for n in sorted(left, reverse=True):  # the longest tier, its gaps filled from the shorter ones
        while n > tiers[1] and left[n]:
            place(mixed(n, longest)[0])
    for tier, below in zip(tiers[1:], (*tiers[2:], 0), strict=True):
        for n in sorted(left, reverse=True):
            while below < n <= tier and left[n]:
                mix, gap = mixed(n, tier)
                if gap:
                    break
                place(mix)
    while rest := [n for n in sorted(left, reverse=True) if left[n]]:
        place(mixed(rest[0], longest)[0])
    return out


def with_steps(places: list[tuple], tiers: tuple[int, ...], step_tokens: int) -> list[tuple]:
    """Places with, instead of what is filled: tier, the first sequence's number within the tier, and the tier's first step group."""
    count, nth = dict.fromkeys(tiers, 0), []
    seen: dict[int, tuple[int, int]] = {}
    for _, lo, hi, k, first, _, filled in places:
        tier = filled if filled in tiers else tiers[0]
        if first not in seen:
            seen[first] = (tier, count[tier])
            count[tier] += (hi - lo) // k
        nth.append(seen[first])
    base, at = {}, 0
    for tier in tiers:
        base[tier] = at
        at += -(-count[tier] * tier // step_tokens)
    return [(*p[:6], tier, n, base[tier]) for p, (tier, n) in zip(places, nth, strict=True)]


def _pieces(frames, path: str, pattern: str, longest: int, end_id: int):
    encode = file_encoder(path, pattern)
    for pdf in frames:
        rows = []
        for key, text in zip(pdf["key"].tolist(), pdf["text"].tolist(), strict=True):
            ids = np.array([*encode(text), end_id], dtype="<u4")
            rows += [(key, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids)) for start, n in cuts(len(ids), longest)]
        yield pd.DataFrame(rows, columns=["key", "start", "length", "ids_crc32", "doc_tokens"])


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, tiers: tuple[int, ...] = TIERS, end_id: int = 0, step_tokens: int = 8192, cell: int = 50_000) -> DataFrame:
    """One row per piece of every row of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    tier, step_group.

    tokenizer_path is a byte-level BPE file of the tokenizers library, readable by workers. A null text is empty and gives the end id
    alone. tier is the size a sequence is padded to: its own where it is a power of two among the tiers, else the longest. Null ids
    and repeated rows are packed like others. The plan is broadcast; it has a few rows for each of at most 1,024 lengths. Pieces of a
    length are ranked in cells of about ``cell`` rows.
    """
    spark = docs.sparkSession
    own = docs.select(id_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    cut = own.mapInPandas(lambda frames: _pieces(frames, tokenizer_path, pattern, tiers[0], end_id), "key string, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = materialize(cut)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    places = spark.createDataFrame(with_steps(plan(counts, tiers), tiers, step_tokens) or [(0, 0, 0, 1, 0, 0, 1, 0, 0)], "length long, lo long, hi long, k long, first long, at long, tier int, nth long, step long")
    ranked = with_rank(pieces, ["length"], F.lit(0), ["key", "start", "ids_crc32"], "rank", salts=max(32, sum(counts.values()) // cell))
    turn = F.col("rank") - F.col("lo")
    placed = ranked.join(F.broadcast(places), ["length"]).where("rank >= lo and rank < hi")
    group = F.floor(turn / F.col("k"))
    return placed.select(
        from_key(F.col("key")).alias("doc_id"),
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("first") + group).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(turn, F.col("k")) * F.col("length")).alias("offset"),
        "tier",
        (F.col("step") + F.floor((F.col("nth") + group) * F.col("tier") / F.lit(step_tokens))).cast("long").alias("step_group"),
    )
