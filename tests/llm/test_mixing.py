"""Counts against Poisson inversion in a loop; shares; hot and many sources."""

from __future__ import annotations

import hashlib
import math

from cataloom.llm import mixing as M


def inverse(rate, u):
    k, p = 0, math.exp(-rate)
    c = p
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def test_counts_invert_the_distribution(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 7) END AS source", "'t' AS text")
    out = M.mix_sources(docs, seed=17).collect()
    n = {}
    for r in docs.collect():
        n[r.source] = n.get(r.source, 0) + 1
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r.copy)
    for r in docs.collect():
        u = int(hashlib.md5(f"17:{r.doc_id}:1".encode()).hexdigest()[:13], 16) / (1 << 52)
        expected = inverse(3000 / len(n) / n[r.source], u)
        assert sorted(got.get(r.doc_id, [])) == list(range(1, expected + 1))
    hot = sum(r.source == "hot" for r in out) / len(out)
    assert abs(hot - 1 / len(n)) < 0.03


def test_salted_join_gives_the_same(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('s', id % 5) AS source")
    a = M.mix_sources(docs).select("doc_id", "copy").collect()
    b = M.mix_sources(docs, broadcast_sources=0).select("doc_id", "copy").collect()
    assert sorted(a) == sorted(b)


def test_weights_and_large_rates(spark):
    docs = spark.range(100).selectExpr("id AS doc_id", "CASE WHEN id < 10 THEN 'few' ELSE 'many' END AS source")
    out = M.mix_sources(docs, {"few": 3.0, "none": 1.0}, target_rows=20_000)
    assert {r.source for r in out.select("source").distinct().collect()} == {"few"}
    assert abs(out.count() - 15_000) < 700


def test_order_is_not_the_input_order(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('s', id % 2) AS source")
    ids = [r.doc_id for r in M.mix_sources(docs).collect()]
    rising = sum(a < b for a, b in zip(ids, ids[1:], strict=False)) / len(ids)
    assert 0.45 < rising < 0.55


def test_hostile(hostile, nothing):
    out = M.mix_sources(hostile, target_rows=1000)
    assert set(out.columns) == set(hostile.columns) | {"n_copies"} and out.where("source IS NULL").count() > 0
    assert out.where("copy < 1").count() == 0
    assert M.mix_sources(nothing).count() == 0


def test_clashing_names(spark):
    docs = spark.range(40).selectExpr("id AS doc_id", "CAST(id % 3 AS string) AS source", "1 AS __source", "2 AS __count", "3 AS __copy", "4 AS __rate")
    for few in (0, 100):
        out = M.mix_sources(docs, broadcast_sources=few)
        assert out.columns == [*docs.columns, "copy", "n_copies", "rate"]
        assert {(r["__source"], r["__count"], r["__copy"], r["__rate"]) for r in out.collect()} == {(1, 2, 3, 4)}
