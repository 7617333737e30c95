"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from textloom.llm import ann


def brute(rows, k, every):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = min(good.get(i, v), v)
    ids, x = np.array(sorted(good)), np.array([good[i] for i in sorted(good)], dtype=float)
    out = {}
    for q in ids[ids % every == 0]:
        score = (x * np.array(good[q])).sum(1)
        others = np.flatnonzero(ids != q)
        out[q] = [(int(ids[j]), score[j]) for j in sorted(others, key=lambda j: (-score[j], ids[j]))[:k]]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(900)]
    rows += [(1000 + i, [1.0] * 8) for i in range(60)]  # ties
    rows += [rows[5], (2000, None), (2001, []), (2002, [0.0] * 8), (2003, [1.0, None] * 4), (2004, [float("nan")] + [1.0] * 7), (2005, [float("inf")] + [1.0] * 7), (2020, [1.0, 2.0]), (None, [1.0] * 8)]
    return rows


def run(spark, rows, **parameters):
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, v int, score int")
    out = {}
    for r in ann.nearest(df, **parameters).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_and_order(spark, vectors):
    want, found = brute(vectors, 20, 20), run(spark, vectors, per_list=100, block=64)
    assert found.keys() == want.keys()
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, got in found.items():
        assert len(got) == 20 and got == sorted(got, key=lambda x: (-x[1], x[0])) and q not in dict(got)


def test_probing_all_lists_without_abandoning_is_exact(spark, vectors, monkeypatch):
    monkeypatch.setattr(ann, "EPSILON", 50.0)
    want, found = brute(vectors, 20, 20), run(spark, vectors, per_list=100, probe_share=1.0)
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(a == pytest.approx(b, rel=1e-12) for q in want for (_, a), (_, b) in zip(want[q], found[q], strict=True))


def test_fewer_than_k(spark, vectors):
    few = vectors[:7]
    assert {q: len(v) for q, v in run(spark, few).items()} == {0: 6}


def test_nothing(spark):
    assert run(spark, []) == {} and run(spark, [(0, None), (20, [0.0, 0.0])]) == {} and run(spark, [(0, [1.0])]) == {}


def test_abandoning_respects_the_radius():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(500, 33)).astype(np.float32), rng.normal(size=(4, 33)).astype(np.float32)
    distance = ((x[None] - q[:, None]) ** 2).sum(2)
    radius = np.sort(distance, axis=1)[:, 20]
    a, b = ann.adaptive_scan(q, x, radius)
    assert (distance[a, b] <= radius[a] * 1.001).all()
    assert len(a) >= 0.9 * (distance <= radius[:, None]).sum()
