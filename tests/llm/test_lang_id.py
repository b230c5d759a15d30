"""Code lengths against a tree walk, byte by byte; held-out accuracy."""

from __future__ import annotations

from collections import Counter
from math import isclose, log2

import numpy as np

from cataloom.llm import lang_id as L
from tests.conftest import SMALL


def walked(train: list[bytes], text: bytes) -> float:
    counts: dict[bytes, Counter] = {}
    for t in train:
        whole = b"\0" * L.MAX_ORDER + t
        for i in range(L.MAX_ORDER, len(whole)):
            for order in range(L.MAX_ORDER + 1):
                counts.setdefault(bytes([order]) + whole[i - order : i], Counter())[whole[i]] += 1
    bits, whole = 0.0, b"\0" * L.MAX_ORDER + text
    for i in range(L.MAX_ORDER, len(whole)):
        for order in range(L.MAX_ORDER, -2, -1):
            if order < 0:
                bits += 8
                break
            seen = counts.get(bytes([order]) + whole[i - order : i])
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if whole[i] in seen:
                bits += -log2(seen[whole[i]] / total)
                break
            bits += -log2(len(seen) / total)
    return bits


def test_code_lengths():
    train = {"x": [b"abracadabra", b"abba"], "y": [b"hello world", "été".encode()]}
    texts = [b"abra", b"hello", b"zzz", "café world abc".encode(), b"a", b"abracadabra hello world" * 30]
    trees = L.Trees.fit({k: L.count_grams(v) for k, v in train.items()})
    got = L.Scorer(trees).code_lengths(texts)
    for i, t in enumerate(texts):
        for k, language in enumerate(trees.languages):
            assert isclose(got[i, k], walked(train[language], t), rel_tol=1e-9)


def test_chunks_change_nothing(monkeypatch):
    trees = L.Trees.fit({"x": L.count_grams([b"some text to learn from"]), "y": L.count_grams([b"andere worte"])})
    texts = [b"text", b"worte und mehr", b"q" * 50]
    whole = L.Scorer(trees).code_lengths(texts)
    monkeypatch.setattr(L, "_CHUNK", 7)
    assert np.allclose(L.Scorer(trees).code_lengths(texts), whole)


def test_held_out_accuracy(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    trees = L.train(docs.where(~L.is_held_out(F.col("doc_id"))))
    rows = L.identify(docs.where(L.is_held_out(F.col("doc_id"))), trees).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_hostile(hostile, nothing, spark):
    trees = L.train(hostile)
    assert trees.languages == ["de", "en", "fr"]
    out = {r.doc_id: r for r in L.identify(hostile, trees).collect()}
    assert {k: out[k].lang_pred for k in (1, 3, 4, 5, 7, 8)} == {1: "en", 3: "und", 4: "und", 5: "de", 7: "und", 8: "fr"}
    assert out[3].score == 0 and L.identify(nothing, trees).count() == 0
    untaught = L.train(nothing)
    assert {r.lang_pred for r in L.identify(hostile, untaught).collect()} == {"und"}
    few = L.train(hostile, train_docs=1)
    assert few.languages == ["de", "en", "fr"]
