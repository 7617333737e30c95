"""Sharding and packing."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from textloom.llm import packing, sharding

JSON = public_tokenizers.path("byte_bpe_50k.json")


def brute_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, room = (low + high) // 2, 1, (low + high) // 2
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_minimax(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(-(2**63), 2**63), rng.choice([9, 20, 300, 5000])) for _ in range(rng.choice([3, 40, 900]))]
    rows += [(rows[0][0], 7)] * 5 + [(rows[0][0] + k, 1000) for k in range(1, 6)]  # neighbours share all but the last bits
    starts, capacity = sharding.boundaries(spark.createDataFrame(rows, "order long, size long"), 7)
    groups = {}
    for order, size in rows:
        groups[order] = groups.get(order, 0) + size
    ordered = [groups[k] for k in sorted(groups)]
    assert capacity == brute_capacity(ordered, 7) and len(starts) == 6
    shards = [sum(v for k, v in groups.items() if sum(k >= s and s < 2**63 - 1 for s in starts) == n) for n in range(7)]
    assert max(shards) <= capacity and sum(shards) == sum(ordered)


def test_shards_on_awkward_rows(awkward, awkward_rows):
    rows = sharding.by_bytes(awkward, 4).collect()
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted((repr(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in awkward_rows)
    by_text, slots = {}, {}
    for r in rows:
        by_text.setdefault(r["group_order"], set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_hot_group_leaves_the_rest_even(spark):
    rows = [(i, "same text " * 40) for i in range(300)] + [(1000 + i, f"text number {i}") for i in range(900)]
    sizes = {}
    for r in sharding.by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect():
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    rest = sorted(sizes.values())[:-1]
    assert len(sizes) == 5 and max(rest) - min(rest) < 200


def test_nothing(nothing):
    assert sharding.by_bytes(nothing).count() == 0
    assert packing.pack(nothing, JSON, public_tokenizers.PATTERN).count() == 0


def test_json_ranks_encode_as_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    own = packing.file_encoder(JSON, public_tokenizers.PATTERN)
    rng = random.Random(8)
    pieces = ["the ", "a's", " 12", "\n\n", "  ", "\t", "ß", "é", "漢字", "🙂", "don't", "<|endoftext|>", " ", "!!", "x" * 50, " ", "é"]
    for _ in range(300):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))
        assert own(text) == library.encode(text, add_special_tokens=False).ids
    assert own("a <|endoftext|> b") == [64, 220, 50256, 275]


@pytest.mark.parametrize("n", [1, 127, 128, 255, 896, 897, 1000, 1023, 1024, 1025, 1920, 1921, 5000])
def test_cuts_cover(n):
    pieces = packing.cuts(n)
    assert [s for s, _ in pieces] == list(np.cumsum([0] + [k for _, k in pieces])[:-1]) and sum(k for _, k in pieces) == n
    assert all(k == 1024 for _, k in pieces[:-1])


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    counts = {n: rng.randint(0, 40) for n in range(1, 1025) if rng.random() < 0.5} | {100: 3000}
    filled = {}
    for n, lo, hi, k, first, at, _ in packing.plan(counts):
        assert (hi - lo) % k == 0
        for r in range(hi - lo):
            filled.setdefault(first + r // k, []).append((at + r % k * n, n))
    total = sum(n * c for n, c in counts.items())
    assert sum(n for s in filled.values() for _, n in s) == total
    for s in filled.values():
        s.sort()
        assert [a for a, _ in s] == list(np.cumsum([0] + [n for _, n in s])[:-1]) and sum(n for _, n in s) <= 1024


def test_pack_on_awkward_rows(awkward, awkward_rows):
    rows = packing.pack(awkward, JSON, public_tokenizers.PATTERN).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    want, found = {}, {}
    for doc, text in awkward_rows:  # every document whole in pieces that follow each other, whatever their lengths
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.setdefault(doc, []).append(np.array(ids, dtype="<u4"))
    for r in rows:
        found.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    assert found.keys() == want.keys()
    for doc, texts in want.items():
        cut = [(s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids)) for ids in texts for s, n, _, size in set(found[doc]) if size == len(ids) and zlib.crc32(ids[s : s + n].tobytes()) in {c for a, _, c, _ in found[doc] if a == s}]
        assert sorted(cut) == sorted(found[doc]) and sum(n for _, n, *_ in cut) == sum(map(len, texts))
    sequences, steps = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["tier"], r["step_group"]))
    for s in sequences.values():
        s.sort()
        assert [o for o, *_ in s] == list(np.cumsum([0] + [n for _, n, *_ in s])[:-1])
        total = sum(n for _, n, *_ in s)
        assert total <= s[0][2] and (total == s[0][2] or s[0][2] == 1024)
        steps.setdefault(s[0][3], []).append(s[0][2])
    assert all(len(set(t)) == 1 and sum(t) <= 8192 for t in steps.values())
    assert 1 - sum(r["length"] for r in rows) / sum(s[0][2] for s in sequences.values()) < 0.05
