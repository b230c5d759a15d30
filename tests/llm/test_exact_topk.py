"""Search against all scores."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cataloom.llm import exact_topk as T


def brute(ids, vectors, queries, k, scale=64):
    whole = [[int(x) for x in v] for v in np.floor(scale * np.array(vectors, dtype=float))]
    out = set()
    for q in queries:
        at = ids.index(q)
        scored = sorted((-(sum(a * b for a, b in zip(whole[at], w, strict=True))), i) for i, w in zip(ids, whole, strict=True) if i != q)
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize(("n", "dims", "spread"), [(300, 40, 1.0), (150, 7, 0.02), (60, 16, 1e6), (5, 3, 1.0)])
def test_search(spark, n, dims, spread):
    r = np.random.default_rng(n)
    vectors = (r.normal(size=(n, dims)) * spread).round(3)
    vectors[n // 2 :: 3] = vectors[0]  # a common vector: ties
    ids = list(range(n))
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")
    out = T.top_k(frame, F.col("vec_id") % 20 == 0, query_block=4, slice_rows=70)
    assert {tuple(x) for x in out.collect()} == brute(ids, vectors, [i for i in ids if i % 20 == 0], 20)


def clustered(n, dims, spread):
    r = np.random.default_rng(1)
    centres = r.normal(size=(16, dims)) * np.geomspace(3, 0.3, dims)
    return np.floor(64 * (centres[r.integers(0, 16, n)] + spread * r.normal(size=(n, dims))))


@pytest.mark.parametrize(("dims", "spread", "most"), [(64, 0.1, 0.15), (128, 0.2, 0.15), (20, 0.3, 0.15)])
def test_steps_prune_without_loss(dims, spread, most):
    vectors = clustered(9000, dims, spread)
    tally = Counter()
    rows, places, scores = T.search(np.arange(50), vectors[:50], np.arange(9000), vectors, 20, tally)
    full = vectors[:50] @ vectors.T
    full[np.arange(50), np.arange(50)] = -np.inf
    for q in range(50):
        order = np.lexsort((np.arange(9000), -full[q]))[:20]
        assert (places[rows == q] == order).all() and (scores[rows == q] == full[q, order]).all()
    blocks = -(-dims // T.DIMENSIONS)
    assert [tally[b] for b in range(1, blocks)] == sorted([tally[b] for b in range(1, blocks)], reverse=True), "survivors only shrink"
    assert tally[blocks - 1] < most * 50 * 9000, "of the pairs, few reach the last block"
    assert sum(tally.values()) < 0.6 * 50 * 9000 * blocks


def test_huge_components(spark):
    """Scores beyond doubles stay exact, those beyond 64 bits count as the nearest long, and none wraps."""
    rows = [(0, [1e7, 1e7]), (1, [1e7, 1e7 + 1]), (2, [1e7, 1e7 - 1]), (20, [1e16, -1e16]), (3, [1e300, 1.0]), (4, [-1e300, 1.0]), (5, [1.7e308, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in T.top_k(frame, F.col("vec_id") % 20 == 0).collect()}
    top, bottom = (1 << 63) - 1, -(1 << 63)
    assert [out[0, r] for r in range(1, 7)] == [(3, top), (5, top), (1, 64 * 64 * (2 * 10**14 + 10**7)), (2, 64 * 64 * (2 * 10**14 - 10**7)), (20, 0), (4, bottom)]
    assert [out[20, r] for r in range(1, 7)] == [(2, top), (3, top), (5, top), (0, 0), (1, bottom), (4, bottom)]


def test_unusable_vectors(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0, None]), (40, None), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (1, []), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (None, [1.0, 1.0]), (3, [1.0, 1.0, 1.0]), (0, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = T.top_k(frame.withColumn("score", F.lit(1)).withColumn("rank", F.lit(1)), F.col("vec_id") % 20 == 0)
    assert sorted(tuple(x) for x in out.collect()) == [(0, 1, 2, 6144), (0, 2, 2, 6144)]
    assert T.top_k(frame.where("false"), F.col("vec_id") % 20 == 0).count() == 0
