"""Recall against brute force, exact scores, ties and vectors that take no part."""

import math

import numpy as np
import pytest

from quadlark.llm import ann

KIND = "vec_id long, embedding array<float>, label int, score double"


def brute(vectors, every, k):
    ids = sorted(vectors)
    out = {}
    for q in ids:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(vectors[q], vectors[i])), i) for i in ids if i != q)
            out[q] = scored[:k]
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_recall(spark, scale):
    """Clustered vectors, of one length or of many."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 24))
    x = centres[rng.integers(0, 20, 3000)] + 0.6 * rng.standard_normal((3000, 24))
    if scale:
        x *= rng.uniform(0.5, 2, (3000, 1))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, 0.0) for i, v in enumerate(x)], KIND)
    found = {}
    for r in ann.search(df).collect():
        found.setdefault(r.query_id, []).append(r)
    exact = x.astype(float) @ x.astype(float).T
    hit = total = 0
    for q in range(0, 3000, 20):
        rows = sorted(found[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert np.allclose([r.score for r in rows], [exact[q, r.vec_id] for r in rows])
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        own = exact[q].copy()
        own[q] = -np.inf
        hit += len(set(np.argsort(-own)[:20]) & {r.vec_id for r in rows})
        total += 20
    assert hit / total >= 0.9


def test_few_and_odd(spark):
    """All candidates if fewer than k; ties to smaller ids; vectors that take no part; a repeated id counts once."""
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, [0.0, 0.0]), (5, None), (6, [None, 1.0]), (7, [math.nan, 1.0]), (8, [math.inf, 1.0]), (9, [1.0]), (None, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [0.0, 2.0])]
    got = ann.search(spark.createDataFrame([(i, v, 0, 0.0) for i, v in rows], KIND)).collect()
    fine = {0: [1.0, 0.0], 1: [1.0, 0.0], 2: [1.0, 0.0], 3: [0.5, 0.5], 20: [0.0, 2.0]}
    want = brute(fine, 20, 20)
    for q in (0, 20):
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want[q]
    assert ann.search(spark.createDataFrame([], KIND)).count() == 0
    assert ann.search(spark.createDataFrame([(0, [1.0], 0, 0.0)], KIND)).count() == 0


def test_hot_vector_and_parts(spark, monkeypatch):
    """A third of all rows is one vector; lists and queries are read in small parts."""
    monkeypatch.setattr(ann, "LIST_PART", 64)
    monkeypatch.setattr(ann, "QUERY_PART", 8)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 8))
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist(), 0, 0.0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int, score double")
    found = {}
    for r in ann.search(df, wanted=1.0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute({i: v.tolist() for i, v in enumerate(x)}, 20, 20)
    assert np.mean([len({i for _, i in w} & found[q]) / 20 for q, w in want.items()]) >= 0.9
    assert {i for _, i in want[0]} == found[0]
