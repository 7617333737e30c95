"""N-gram join and line deduplication against brute force."""

import hashlib
import random
from itertools import combinations
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from textloom.llm import line_dedup, ngram_join
from textloom.llm.common import Forest, binomial_tail_below, bucket_units, components, scratch_dir
from textloom.llm.queries import op5_line_dedup
from textloom.llm.shingles import WordHasher, exact_sets, words_of


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_near(rows, threshold=0.8):
    """Sorted (doc_id, class_id, text_id, n_copies, n_links, n_text_links) by all pairs of rows."""
    low = lambda i: -(2**63) - 1 if i is None else i
    texts = [t or "" for _, t in rows]
    sets = [shingles(t) for t in texts]
    forest, links, near = Forest(len(rows)), [0] * len(rows), [set() for _ in rows]
    for i, j in combinations(range(len(rows)), 2):
        same = texts[i] == texts[j]
        if same or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9):
            forest.join(i, j)
            links[i] += 1
            links[j] += 1
            if not same:
                near[i].add(texts[j])
                near[j].add(texts[i])
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = forest.find(i)
        least[r] = min(least.get(r, 2**63), low(doc))
    out = []
    for i, (doc, _) in enumerate(rows):
        first = min(low(d) for (d, _), t in zip(rows, texts, strict=True) if t == texts[i])
        up = lambda x: None if x < -(2**63) else x
        out.append((doc, up(least[forest.find(i)]), up(first), texts.count(texts[i]), links[i], len(near[i])))
    return sorted(out, key=repr)


def test_near_texts_on_awkward_rows(awkward, awkward_rows):
    found = sorted(map(tuple, ngram_join.near_texts(awkward).collect()), key=repr)
    assert found == brute_near(awkward_rows)


def test_near_texts_in_blocks(spark):
    """A group larger than a block is dealt into pairs of blocks and loses no link."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):
        own = list(words)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.near_texts(df, block=7).collect()), key=repr) == brute_near(rows)


def test_nothing(nothing):
    assert ngram_join.near_texts(nothing).count() == 0
    assert ngram_join.one_per_class(nothing).count() == 0
    assert line_dedup.report(nothing).count() == 0
    assert line_dedup.without_repeats(nothing).count() == 0


def test_one_per_class_keeps_each_class(awkward, awkward_rows):
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.one_per_class(awkward).collect()]
    classes = {(c, d == c and d == t) for d, c, t, *_ in brute_near(awkward_rows)}
    assert {d for d, _ in kept} == {c for c, _ in classes}
    assert kept.count((8, awkward_rows[8][1])) == 1
    assert ngram_join.one_per_class(awkward).columns == awkward.columns


def test_pruning_keeps_likely_pairs():
    least = ngram_join.least_matches(0.8, 1e-6, 64)
    assert binomial_tail_below(64, least, 0.8) >= 1e-6 > binomial_tail_below(64, least - 1, 0.8)
    assert 25 < least < 45


def test_minhash_estimates_similarity():
    hasher = WordHasher()
    a = " ".join(f"w{i}" for i in range(1000))
    b = " ".join(f"w{i}" for i in range(100, 1100))
    h, bounds = words_of([a, b], hasher)
    sig = ngram_join.minhashes(h, bounds, 400)
    assert (sig[0] == sig[1]).mean() == pytest.approx(900 / 1100, abs=0.06)


def test_equal_shingles_have_equal_hashes():
    hasher = WordHasher()
    h, bounds = words_of(["a b c d e f", "x a b  c D\ne", "", "b"], hasher, 5)
    assert bounds.tolist() == [0, 2, 4, 4, 5] and h[0] == h[3] and len(set(h.tolist())) == 4


def test_overlaps_count_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, 80).astype(np.uint64)) for _ in range(9)]
    found = ngram_join.overlaps(sets)
    assert all(found[i, j] == len(np.intersect1d(sets[i], sets[j])) for i, j in combinations(range(9), 2))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(1000 + i, 1001 + i) for i in range(70)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    forest = Forest(1200)
    for a, b in edges:
        forest.join(a, b)
    assert found == {x: forest.find(x) for e in edges if e[0] != e[1] for x in e}


def test_units_let_every_pair_meet(spark):
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 7), (3, 8), (3, 9)], "key long, m long")
    units = {}
    for r in bucket_units(rows, "key", "m", 10).collect():
        units.setdefault(r["unit"], set()).add((r["key"], r["m"]))
    met = {frozenset(p) for u in units.values() for p in combinations(u, 2)}
    assert all(frozenset(((1, i), (1, j))) in met for i, j in combinations(range(50), 2)) and frozenset(((3, 8), (3, 9))) in met
    assert max(map(len, units.values())) < 40 and not any((2, 7) in u for u in units.values())


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, d in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (c != d))
    return row[-1]


def test_edit_within():
    rng = random.Random(4)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        limit = rng.randint(0, 6)
        assert line_dedup.edit_within(a, b, limit) == (edit(a, b) <= limit)


def test_bounds_of_the_edit_distance():
    rng = random.Random(5)
    for _ in range(400):
        a = "".join(rng.choice("abcé d") for _ in range(rng.randint(0, 60)))
        b = list(a)
        for _ in range(rng.randint(0, 9)):
            b[rng.randint(0, len(b)) : rng.randint(0, len(b))] = rng.choice(["", "x", "yz"])
        b = "".join(b)
        true = edit(a, b)
        assert line_dedup.cost_at_most(a, b) >= true
        counts = line_dedup.pair_counts([a, b], np.array([len(a), len(b)]))
        assert line_dedup.may_be_within(counts, np.array([0]), np.array([1]), np.array([true]))[0]


def brute_lines(rows, min_words=5):
    """{(doc_id, line_no): (keep doc_id, keep line_no)} by all pairs of distinct normalised lines."""
    low = lambda i: -(2**63) if i is None else i
    spots = [(low(d), k, line_dedup.normalised(x)) for d, t in rows for k, x in enumerate((t or "").split("\n"))]
    spots = [s for s in spots if len(s[2].split()) >= min_words]
    lines = sorted({s[2] for s in spots})
    forest = Forest(len(lines))
    for i, j in combinations(range(len(lines)), 2):
        a, b = lines[i], lines[j]
        if line_dedup.edit_within(a, b, int(0.2 * max(len(a), len(b)) + 1e-9)):
            forest.join(i, j)
    at = {x: forest.find(i) for i, x in enumerate(lines)}
    keep = {}
    for d, k, x in spots:
        keep[at[x]] = min(keep.get(at[x], (2**63, 0)), (d, k))
    return {(d, k): keep[at[x]] for d, k, x in spots}


def test_lines_on_awkward_rows(awkward, awkward_rows):
    want = brute_lines(awkward_rows)
    low = lambda i: -(2**63) if i is None else i
    found = line_dedup.report(awkward).collect()
    # rows that share an id but not a text are told apart inside, so compare all but those
    shared = {low(d) for d, _ in awkward_rows if [x for x, _ in awkward_rows].count(d) > 1}
    for r in found:
        spot = (low(r["doc_id"]), r["line_no"])
        if spot[0] not in shared:
            assert (low(r["keep_doc_id"]), r["keep_line_no"]) == want[spot], spot
    assert {(low(r["doc_id"]), r["line_no"]) for r in found} == set(want)
    assert any(not r["kept"] for r in found)


def test_near_lines_are_found(spark):
    words = [f"word{k}x" for k in range(120)]
    rows = [(i, " ".join(words[:i] + [f"other{i}"] + words[i + 1 :])) for i in range(40)] + [(99, "something else that is not like the others at all")]
    found = line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    near = [r for r in found if r["doc_id"] != 99]
    assert sum(r["keep_doc_id"] == near[0]["keep_doc_id"] for r in near) >= 30
    assert [r["kept"] for r in found if r["doc_id"] == 99] == [True]


def test_line_hashes_follow_the_words():
    text = " ".join(f"t{k}" for k in range(1500))
    _, number, words, digests, bands = line_dedup.line_hashes([text + "\n\nx y, Z", text.upper() + "\n ?! \nX  y z"], WordHasher())
    assert number.tolist() == [0, 2, 0, 2] and words.tolist() == [1500, 3, 1500, 3]
    assert digests[0] == digests[2] != digests[1] == digests[3] and (bands[:2] == bands[2:]).all()


def test_digests_are_those_of_normalised_lines():
    text = "  One,  two;\tthree 漢字 \n\n \x1f \r\nß  9 \u00a0 x\n!!\nend -"
    _, _, _, digests, _ = line_dedup.line_hashes([text, "", "a\n b  c "], WordHasher())
    lines = [line_dedup.normalised(x) for x in text.split("\n") + ["", "a", " b  c "]]
    assert digests == [hashlib.md5(x.encode()).digest() for x in lines if x]


def thue_morse(n):
    return "".join("ab"[k.bit_count() & 1] for k in range(n))


def test_texts_that_meet_in_weak_hashes_stay_apart(spark):
    """A polynomial hash modulo a power of two gives a Thue-Morse word and its complement one value."""
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, one), (2, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["n_links"] for r in ngram_join.near_texts(df).collect()] == [0, 0]
    assert all(r["kept"] for r in line_dedup.report(df, short=True).collect())
    h, _ = words_of([one, other], WordHasher(), 1)
    assert h[0] != h[1]


def test_exact_sets_compare_words():
    a, b, c, d = exact_sets(["a b c d e f", "x a b  c D\ne", "", "b"], 5)
    assert len(a) == len(b) == 2 and len(np.intersect1d(a, b)) == 1 and not len(c) and len(d) == 1


def test_least_id_is_an_id(spark):
    rows = [(-(2**63), "one text of at least five words"), (None, "one text of at least five words"), (7, "another line that is alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.near_texts(df).collect()), key=repr) == brute_near(rows)
    kept = {(r["doc_id"], r["kept"]) for r in line_dedup.report(df).collect()}
    assert kept == {(-(2**63), False), (None, True), (7, True)}


def test_one_row_of_a_group_is_kept(spark):
    line = "this very line stands in rows that repeat"
    df = spark.createDataFrame([(1, line)] * 3 + [(2, line + " again")], "doc_id long, text string")
    assert sum(r["kept"] for r in line_dedup.report(df).collect()) == 1
    assert [r["text"] for r in line_dedup.without_repeats(df).collect()] == [line]


def test_repeats_go(spark):
    line = "this very line stands in two of the documents here"
    rows = [(1, f"{line}\nfirst own line of the first document", 0), (2, f"short\n{line}\nsecond own line in the other document", 0), (3, line, 0), (4, "a b", 0), (5, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_dedup.without_repeats(df).collect()}
    assert found[1] == (rows[0][1], 0) and found[2] == ("short\nsecond own line in the other document", 43)
    assert 3 not in found and found[4] == ("a b", 0) and found[5] == (None, 0)


def test_one_replaced_word_is_found_in_lines_of_any_length(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(6))
    rows = []
    for i in range(60):
        line = [word() for _ in range((8, 15, 30, 60)[i % 4])]
        other = list(line)
        other[rng.randrange(len(line))] = word()
        rows += [(2 * i, " ".join(line)), (2 * i + 1, " ".join(other))]
    found = line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["doc_id"] % 2 == 1 and r["keep_doc_id"] == r["doc_id"] - 1 for r in found) >= 57


def test_recall_against_edit_similarity_alone(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    lines = sorted({n for _, t in rows for x in (t or "").split("\n") if len((n := line_dedup.normalised(x)).split()) >= 5})
    found = {}
    for r in line_dedup.report(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect():
        found[r["doc_id"]] = r["keep_doc_id"]
    near = []
    for i, j in combinations(range(len(lines)), 2):
        a, b = lines[i], lines[j]
        longest = max(len(a), len(b))
        if 5 * abs(len(a) - len(b)) <= longest and len(set(a.split()) & set(b.split())) >= 3 and line_dedup.edit_within(a, b, int(0.2 * longest + 1e-9)):
            near.append((i, j))
    assert len(near) > 20 and np.mean([found[i] == found[j] for i, j in near]) > 0.97


def test_short_lines_are_grouped_where_equal(spark, tmp_path):
    rows = [(1, "All rights reserved.\n\nall right reserved\na line of more than five words"), (2, "all rights RESERVED"), (3, "own")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {(r["doc_id"], r["line_no"]): (r["keep_doc_id"], r["keep_line_no"], r["n_lines"], r["kept"]) for r in op5_line_dedup(spark, str(tmp_path)).collect()}
    assert found == {(1, 0): (1, 0, 2, True), (1, 2): (1, 2, 1, True), (1, 3): (1, 3, 1, True), (2, 0): (1, 0, 2, False), (3, 0): (3, 0, 1, True)}


def test_short_own_lines_outlive_a_repeated_line(spark):
    line = "this very line stands in two of the documents here"
    rows = [(1, line), (2, f"milk\n{line}\nbrown bread\n"), (3, f" \n{line}\n ")]
    found = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: line, 2: "milk\nbrown bread\n"}


def test_many_distances_at_once():
    rng = random.Random(3)
    texts, limit = [], []
    for n in range(240):
        a = "".join(rng.choice("abcdefgh 漢🙂") for _ in range(rng.choice((5, 60, 64, 130, 400)) + n % 7))
        b, k = list(a), rng.randrange(len(a) // 3 + 1)
        if n % 3:  # edits anywhere, else the text moves, so that the way runs along the edge of the band
            for _ in range(k):
                b[rng.randrange(len(b))] = rng.choice("abcd ")
        else:
            b = b[k:] + ["x"] * k
        texts += [a, "".join(b)] if n % 2 else ["".join(b), a]
        exact = next(x for x in range(len(a) + 1) if line_dedup.edit_within(a, "".join(b), x))
        limit.append(max(0, exact - n % 4 // 2) if n % 5 else len(a) // 5)
    i = np.arange(0, len(texts), 2)
    want = [line_dedup.edit_within(texts[x], texts[x + 1], most) for x, most in zip(i, limit, strict=True)]
    assert 50 < sum(want) < 230
    for few in (2, 24):
        assert line_dedup.within_many(texts, i, i + 1, np.array(limit), few).tolist() == want


def test_lines_that_meet_by_chance_are_compared_together(monkeypatch):
    """300 lines of a unit with a common beginning, every tenth near the one before: no pair is worked through alone."""
    rng = random.Random(8)
    lexicon = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(200)]
    words = [rng.choice(lexicon) for _ in range(20)]
    lines = []
    for n in range(300):
        tail = [rng.choice(lexicon) for _ in range(30)]
        lines.append(" ".join(words + tail) if n % 10 else lines[-1].replace("a", "b") + " x" if lines else "a line of its own")
    pdf = pd.DataFrame({"unit": 1, "half": 0, "rid": range(len(lines)), "band": 0, "text": lines})
    calls, alone = [], line_dedup.edit_within
    monkeypatch.setattr(line_dedup, "edit_within", lambda *a: calls.append(a) or alone(*a))
    monkeypatch.setattr(line_dedup, "line_hashes", lambda t, h: (None,) * 4 + (np.zeros((len(lines), line_dedup.BANDS * line_dedup.WIDTH), np.uint8),))
    found = Forest(len(lines))
    for part in line_dedup.near_edges(iter([pdf]), 0.8):
        for a, b in zip(part["a"], part["b"], strict=True):
            found.join(a, b)
    brute = Forest(len(lines))
    for i, j in combinations(range(len(lines)), 2):
        if alone(lines[i], lines[j], int(0.2 * max(len(lines[i]), len(lines[j])) + 1e-9)):
            brute.join(i, j)
    assert [found.find(x) for x in range(len(lines))] == [brute.find(x) for x in range(len(lines))]
    assert 1 < len({brute.find(x) for x in range(len(lines))}) and len(calls) < 300


def test_halves_leave_no_near_pair_out():
    rng = random.Random(12)
    texts, limit = [], []
    for n in range(300):
        a = "".join(rng.choice("abcdé 漢") for _ in range(rng.choice((0, 3, 40, 64, 65, 200, 700)) + n % 5))
        b, k = list(a), rng.randrange(len(a) // 4 + 1)
        if n % 3:
            for _ in range(k):
                at = rng.randrange(len(b) + 1)
                b[at : at + rng.randrange(2)] = rng.choice(["", "x", "yz"])
        else:  # the middle moves as far as it can
            b = b[k:] if n % 2 else ["x"] * k + b
        texts += [a, "".join(b)]
        limit.append(next(x for x in range(len(a) + len(b) + 1) if line_dedup.edit_within(a, "".join(b), x)))
    size, i, limit = np.array(list(map(len, texts))), np.arange(0, len(texts), 2), np.array(limit)
    for cells in (8, 64):
        assert line_dedup.halves_may_be_within(texts, size, i, i + 1, limit, cells).all()
        assert line_dedup.halves_may_be_within(texts, size, i + 1, i, limit, cells, chunk=7).all()


def test_lines_with_other_halves_are_not_compared(monkeypatch):
    """Lines of the same pairs of letters in another order: bounds tell them apart, no distance is computed."""
    rng = random.Random(13)
    lines = []
    for _ in range(20):
        one, two = (" ".join("".join(rng.choice(a) for _ in range(6)) for _ in range(30)) for a in ("abcdefgh", "rstuvwxy"))
        lines += [f"{one} {two}", f"{two} {one}"]
    pdf = pd.DataFrame({"unit": np.repeat(range(20), 2), "half": 0, "rid": range(len(lines)), "band": 0, "text": lines})
    calls, many = [], line_dedup.within_many
    monkeypatch.setattr(line_dedup, "within_many", lambda *a: calls.append(a) or many(*a))
    monkeypatch.setattr(line_dedup, "line_hashes", lambda t, h: (None,) * 4 + (np.zeros((len(lines), line_dedup.BANDS * line_dedup.WIDTH), np.uint8),))
    assert sum(map(len, line_dedup.near_edges(iter([pdf]), 0.8))) == 0 and not calls


def test_units_with_the_same_least_line_are_side_by_side():
    """Buckets of like members, and another: the names of the first differ, but not in the bits by which they are dealt out."""
    buckets = [(1, [7, 9, 11]), (2, [7, 9]), (3, [7, 9, 11, 30]), (4, [9, 11]), (5, [7, 9])]
    key, rid = (np.array(x, dtype=np.uint64) for x in zip(*[(k << 40 | k, r) for k, members in buckets for r in members], strict=True))
    row = {"part": 0, "key_low": key.astype(np.uint32).tobytes(), "key_high": (key >> np.uint64(32)).astype(np.uint16).tobytes()}
    row |= {"rid_low": rid.astype(np.uint32).tobytes(), "rid_high": (rid >> np.uint64(32)).astype(np.uint32).tobytes()}
    found = line_dedup.bucket_rows(pd.DataFrame([row]), 300)
    names = {k: tuple(sorted(g["rid"])) for k, g in found.drop_duplicates(["unit", "rid"]).groupby("unit")}
    assert sorted(names.values()) == [(7, 9), (7, 9, 11), (7, 9, 11, 30), (9, 11)]
    assert len({k >> (64 - line_dedup.FAMILY) for k, m in names.items() if m[0] == 7}) == 1


def near_family(n, rng, words=40):
    """Distinct lines of which all are near the first."""
    line = ["".join(rng.choice("abcdefghilmnoprstuv") for _ in range(6)) for _ in range(words)]
    return [" ".join([*line, f"{k:b}".replace("0", "x").replace("1", "y")]) for k in range(n)]


def test_links_of_a_large_group_grow_with_its_lines(spark, monkeypatch):
    """A line of a large group, or a guest of its blocks, has a link per band at most, not one for every block that its block meets."""
    sent, settle = [], line_dedup.components
    monkeypatch.setattr(line_dedup, "components", lambda edges: sent.append(edges.count()) or settle(edges))
    monkeypatch.setattr(line_dedup.near_edges, "__defaults__", (1 << 12, 1 << 23))  # letters looked at together: a few units
    lines = near_family(1200, random.Random(2), 12)
    found = line_dedup.report(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(2), block=10).collect()
    assert sum(r["kept"] for r in found) == 1 and {r["n_lines"] for r in found} == {1200}
    assert sum(sent) <= 2 * line_dedup.BANDS * 1200


def test_large_buckets_lose_no_link(spark):
    """Near lines in common buckets larger than a block, tied by a few links only, and lines that only meet there: as all pairs say."""
    rng = random.Random(6)
    common = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    lines = near_family(60, rng)
    for _ in range(40):  # chains: each line is near the next, far from those after it
        tail = "".join(rng.choice("abcdefgh ") for _ in range(110))
        lines += [f"{common} {tail}"]
        for _ in range(3):
            at = rng.randrange(len(tail) - 60)
            tail = tail[:at] + "".join(rng.choice("ijklmnop ") for _ in range(55)) + tail[at + 55 :]
            lines += [f"{common} {tail}"]
    rng.shuffle(lines)
    rows = list(enumerate(lines))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for similarity in (0.88, 0.92):
        forest = Forest(len(lines))
        clean = [line_dedup.normalised(x) for x in lines]
        for i, j in combinations(range(len(lines)), 2):
            if line_dedup.edit_within(clean[i], clean[j], int((1 - similarity) * max(len(clean[i]), len(clean[j])) + 1e-9)):
                forest.join(i, j)
        at = {(i, 0): forest.find(i) for i in range(len(lines))}
        found = {(r["doc_id"], r["line_no"]): r["keep_doc_id"] for r in line_dedup.report(df, similarity=similarity, block=8).collect()}
        assert found == at and 2 < len(set(at.values())) < 200


def test_tables_that_no_result_needs_are_deleted(spark):
    """Beside the lines and their classes nothing stays in the shared folder, with large buckets or without, and the result can be read."""
    folder = Path(scratch_dir(spark).removeprefix("file:"))
    lines = near_family(40, random.Random(7), 12)
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    for block in (10, 300):
        before = set(folder.glob("textloom-*"))
        found = line_dedup.report(df, block=block)
        assert len(set(folder.glob("textloom-*")) - before) == 2
        assert [r["n_lines"] for r in found.collect()] == [40] * 40


def test_lines_of_different_roots_and_like_length_meet_in_one_unit():
    rng = np.random.default_rng(4)
    for n, roots in ((50, 1), (90, 4), (90, 90), (200, 30)):
        root = np.arange(n) if roots == n else np.minimum(rng.geometric(0.3, n), roots)
        size = rng.integers(30, 400, n)
        pdf = pd.DataFrame({"key": 7, "rid": np.arange(n), "band": 0, "root": root, "size": size})
        met = set()
        for unit in (u for part in line_dedup.cross_rows(pdf, 10, 0.8, 64) for _, u in part.groupby("unit")):
            i, j = np.triu_indices(len(unit), 1)
            own = line_dedup.own_pairs(unit["half"].to_numpy(), i, j)
            pairs = [tuple(sorted(x)) for x in zip(unit["rid"].to_numpy()[i[own]].tolist(), unit["rid"].to_numpy()[j[own]].tolist(), strict=True)]
            assert not met & set(pairs)
            met |= set(pairs)
        like = lambda i, j: abs(int(size[i]) - int(size[j])) <= 0.2 * max(size[i], size[j]) + 1e-9
        assert {(i, j) for i, j in combinations(range(n), 2) if root[i] != root[j] and like(i, j)} <= met
        assert len(met) < (0.65 if roots > 1 else 0.01) * n * (n - 1) / 2


def test_dear_bounds_are_for_pairs_left_over(monkeypatch):
    """All lines of a unit are near the first, so none of their 780 pairs is left for the bound by halves."""
    lines = near_family(40, random.Random(15), 12)
    pdf = pd.DataFrame({"unit": 1, "half": 0, "rid": range(40), "band": 0, "text": lines})
    asked, halves = [], line_dedup.halves_may_be_within
    monkeypatch.setattr(line_dedup, "halves_may_be_within", lambda *a: asked.append(len(a[2])) or halves(*a))
    monkeypatch.setattr(line_dedup, "line_hashes", lambda t, h: (None,) * 4 + (np.zeros((40, line_dedup.BANDS * line_dedup.WIDTH), np.uint8),))
    links = pd.concat(line_dedup.near_edges(iter([pdf]), 0.8))
    assert len(links) == 39 and sum(asked) < 100


def test_long_near_texts_need_no_distance():
    rng = random.Random(16)
    words = ["".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(3, 9))) for _ in range(1500)]
    a, b = " ".join(words), " ".join(w if k % 12 else "new" for k, w in enumerate(words))
    assert edit(a[:900], b[:900]) <= line_dedup.cost_at_most(a[:900], b[:900])
    assert line_dedup.cost_at_most(a, b) <= 0.2 * len(a)


def test_lines_of_chunks_find_their_groups():
    """Two chunks with lines in common: each line is told the first occurrence and the count of its group, all by way of byte strings."""
    rng = np.random.default_rng(17)
    pieces, rows = [], []
    for base, n in ((0, 90), (1 << 36, 70)):
        known, ids, th, line, words = rng.integers(0, 2, n), rng.integers(-3, 3, n), rng.integers(0, 2, n), rng.integers(0, 3, n).astype(np.int32), np.full(n, 7)
        ids, text = np.where(known, ids, 0), rng.integers(0, 60, n)
        h = np.array([np.frombuffer(hashlib.md5(str(t).encode()).digest(), "<u8") for t in text])
        bands = np.repeat(text[:, None], line_dedup.BANDS * line_dedup.WIDTH, 1).astype(np.uint8)
        pieces.append(line_dedup.line_pieces(base, known, ids, th, line, words, h, bands, 5))
        rows += zip(known.tolist(), ids.tolist(), line.tolist(), th.tolist(), (base + np.arange(n)).tolist(), text.tolist(), strict=True)
    pieces = pd.concat(pieces)
    distinct = pd.concat(line_dedup.distinct_lines(pieces[pieces["own"] == 0].sort_values("part", kind="stable")))
    assert sum(distinct["lines"]) == len({r[-1] for r in rows})
    first = {t: min(r[:5] for r in rows if r[-1] == t) for t in {r[-1] for r in rows}}
    count = {t: sum(r[-1] == t for r in rows) for t in first}
    told = pd.concat(line_dedup.replies(iter([distinct.assign(picks=None)])))
    own = pieces[pieces["own"] == 1][["chunk", "known", "id", "th", "line", "words", "local"]]
    found = pd.concat(line_dedup.answered(pd.concat([own, told]).sort_values("chunk", kind="stable")))
    assert len(found) == len(rows)
    for got, r in zip(found.itertuples(), rows, strict=True):
        assert (got.keep_known, got.keep_id, got.keep_line, got.lines, got.kept) == (*first[r[-1]][:3], count[r[-1]], first[r[-1]][4] == r[4])
