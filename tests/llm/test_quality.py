"""Estimates against planted truth; accuracy against labels that the model never sees."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from cataloom.llm import quality as Q
from tests.conftest import SMALL


def test_votes():
    good = "Some ordinary prose with different words in it. It goes on for a while, and then it ends here."
    assert Q.votes_of(good).count("0") == 0
    assert Q.votes_of("$$$ ### %%% &&& *** $$$ ### %%%")[0] == "0"
    assert Q.votes_of("again " * 40)[1] == "0"
    assert Q.votes_of("SHOUTING ALL OF THE TIME ABOUT IT")[3] == "0"
    assert Q.votes_of(None) == Q.votes_of("  ") == "0" * len(Q.LABELLERS)


def test_estimates_recover_planted_accuracies():
    r = np.random.default_rng(0)
    n = len(Q.LABELLERS)
    truth = r.random(20_000) < 0.8
    hit = r.random((20_000, n)) < 0.95
    votes = np.where(hit == truth[:, None], 2, 0)
    votes[r.random(votes.shape) < 0.3] = 1
    patterns = {}
    for row in votes:
        key = "".join(map(str, row))
        patterns[key] = patterns.get(key, 0) + 1
    posteriors, _ = Q.fit_labellers(patterns)
    guessed = np.array([posteriors["".join(map(str, row))] > 0.5 for row in votes])
    assert (guessed == truth).mean() > 0.97
    assert Q.fit_labellers({})[0] == {}


def test_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = Q.classify(docs, Q.fit(docs)).where(F.col("doc_id").isin(list(labels))).collect()
    assert sum(r.keep == bool(labels[r.doc_id]) for r in rows) >= 0.93 * len(rows)
    assert all(r.keep for r in rows if labels[r.doc_id] and r.votes.count("0") == 0)


def test_hostile(hostile, nothing):
    out = Q.classify(hostile, Q.fit(hostile))
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == hostile.count() and rows[3].score == 0 and not rows[4].keep and set(out.columns) == set(hostile.columns) | {"posterior", "keep"}
    assert Q.classify(nothing, Q.fit(nothing)).count() == 0


def test_scorer_against_brute_force():
    """Training against the same steps written out weight by weight; scoring against the sum over features."""
    texts = ["good words here", "bad bad bad $$$ word", "more good words", "$$$ bad"]
    targets = [0.9, 0.1, 0.8, 0.2]
    rows = [Q.features(t) for t in texts]
    weights, past = {}, {}
    slots = sorted({s for r in rows for s in r})
    for s in slots:
        weights[s], past[s] = 0.0, 1e-8
    for _ in range(25):
        errors = [(1 / (1 + math.exp(-sum(v * weights[s] for s, v in r.items()))) - t) / len(rows) for r, t in zip(rows, targets, strict=True)]
        for s in slots:
            gradient = sum(e * r.get(s, 0.0) for e, r in zip(errors, rows, strict=True)) + 1e-5 * weights[s]
            past[s] += gradient**2
            weights[s] -= 0.4 * gradient / math.sqrt(past[s])
    trained = Q.train_scorer(rows, targets, rounds=25)
    assert all(abs(trained[s] - weights[s]) < 1e-9 for s in slots)
    scorer = Q.WordScorer(trained)
    for text, row in zip(texts, rows, strict=True):
        assert abs(scorer.score(text) - 1 / (1 + math.exp(-sum(v * trained[s] for s, v in row.items())))) < 1e-9


def test_sample_is_fixed_where_identifiers_repeat(spark):
    """One identifier with many texts: the sample keeps its bound, and neither order nor partitions change the model."""
    rows = [(i % 3, f"text {i} with some words {i * 7 % 11} and $$$ now and then" * (1 + i % 4)) for i in range(400)] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    models = [Q.fit(frame.repartition(n).orderBy(F.rand(n)), train_rows=50) for n in (1, 5)]
    assert np.allclose(models[0].weights, models[1].weights) and models[0].weights.any()


def test_long_words_and_texts(spark):
    long = "x" * 40 + "1"
    assert Q.word_slots(long) != Q.word_slots("x" * 40)
    frame = spark.createDataFrame([(1, "word " * 300_000), (2, "y" * 1_000_000), (3, "plain text of a few words")], "doc_id long, text string")
    out = {r.doc_id: r for r in Q.classify(frame, Q.fit(frame)).collect()}
    assert len(out) == 3 and out[1].votes[1] == "0"
