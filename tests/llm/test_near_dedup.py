"""Classes against all pairs; hot buckets of several blocks; estimates against exact similarities."""

from __future__ import annotations

import random

import numpy as np

from cataloom.llm import near_dedup as N


def words(r, n):
    return [f"w{r.randrange(3000)}" for _ in range(n)]


def corpus():
    r = random.Random(11)
    docs = [" ".join(words(r, r.randrange(40, 200))) for _ in range(60)]
    passage = " ".join(words(r, 60))
    for base in range(20):
        own = docs[base].split()
        for edits in (1, 2, 4, 8):
            copy = list(own)
            for _ in range(edits):
                copy[r.randrange(len(copy))] = f"x{r.randrange(10_000)}"
            docs.append(" ".join(copy))
        docs.append(" ".join(own).upper())
    docs += [" ".join(words(r, 150)) + " " + passage for _ in range(30)]
    docs += ["", " \n ", "one two", "One  two", "one two three"]
    return docs


def expected_classes(docs, threshold=N.THRESHOLD):
    texts = [d.encode() for d in docs]
    found = N.Shingles(texts)
    values, _, _ = N.distinct(found.values, found.cuts)
    idf = N.idf_table(np.bincount(N._cells(values), minlength=1 << N.CELLS_LOG2))
    values, weights, cuts, keys = N.weighted(texts, idf)
    sets = [dict(zip(values[a:b].tolist(), weights[a:b].astype(float), strict=True)) for a, b in zip(cuts, cuts[1:], strict=False)]
    label = list(range(len(docs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            shared = sum(min(w, sets[j].get(s, 0.0)) for s, w in sets[i].items())
            total = sum(sets[i].values()) + sum(sets[j].values()) - shared
            if (keys[i] == keys[j]).all() or total and shared / total >= threshold:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return {i: root(i) for i in range(len(docs))}


def classes_of(spark, docs, **kw):
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    return {r.id: r.class_id for r in N.near_duplicate_classes(frame, **kw).collect()}


def test_classes(spark):
    docs = corpus()
    assert classes_of(spark, docs) == expected_classes(docs)


def test_buckets_of_several_blocks(spark):
    r = random.Random(2)
    base = words(r, 120)
    docs = []
    for _ in range(90):
        copy = list(base)
        for _ in range(r.randrange(0, 4)):
            copy[r.randrange(len(copy))] = f"x{r.randrange(10_000)}"
        docs.append(" ".join(copy))
    assert classes_of(spark, docs, block=8) == expected_classes(docs)


def test_recall_over_planted_edits(spark):
    """Copies with 0 to 20 % of their words edited: every pair of the threshold or more is joined, and none below it alone."""
    r = random.Random(4)
    docs = []
    for _ in range(40):
        base = words(r, r.randrange(100, 300))
        docs.append(" ".join(base))
        for share in (0.002, 0.005, 0.01, 0.015, 0.02, 0.05, 0.1, 0.2):
            copy = list(base)
            for at in r.sample(range(len(copy)), max(1, int(share * len(copy)))):
                copy[at] = f"x{r.randrange(100_000)}"
            docs.append(" ".join(copy))
    got, want = classes_of(spark, docs), expected_classes(docs)
    joined = [i for i in want if want[i] != i]
    assert len(joined) > 80
    assert sum(got[i] == want[i] for i in joined) >= 0.99 * len(joined)
    assert all(got[i] == want[i] for i in want if want[i] == i)


def test_identifiers_that_repeat(spark):
    """All texts of an identifier are one document, and what is like any of them belongs to it."""
    r = random.Random(6)
    a, b, c = (words(r, 100) for _ in range(3))
    rows = [(5, a), (5, b), (5, c), (7, [*b[:50], "x", *b[51:]]), (8, [*c[:50], "y", *c[51:]]), (9, words(r, 100))]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    assert {x.id: x.class_id for x in N.near_duplicate_classes(frame).collect()} == {5: 5, 7: 5, 8: 5, 9: 9}


def test_clashing_names_and_a_very_long_text(spark):
    text = " ".join(words(random.Random(8), 250_000))
    rows = [(1, text, "a", "b"), (2, text + " more", "a", "b"), (3, "short", "a", "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __near_id string, __near_class string")
    out = N.mark_near_duplicates(frame)
    assert {x.doc_id: (x.class_id, x.kept) for x in out.collect()} == {1: (1, True), 2: (1, False), 3: (3, True)}
    assert out.columns == [*frame.columns, "class_id", "kept"] and N.deduplicate(frame).columns == frame.columns


def test_inverse_document_frequency():
    """Rare shingles weigh twice as much as one that makes up everything, also where every cell is filled."""
    counts = np.array([1, 10, 1000, 0])
    steps = N.idf_table(counts)
    assert steps[0] == N.IDF_STEPS and steps[0] >= steps[1] > steps[2]
    filled = np.full(1 << 12, 100_000)
    filled[7] = 50_000_000
    assert (np.delete(N.idf_table(filled), 7) == N.IDF_STEPS).all() and N.idf_table(filled)[7] < N.IDF_STEPS // 2


def test_words_not_spacing_or_case_count():
    a = N.Shingles([b"A b  C d e f", b"a B\tc D e F", b"a b c d f e"])
    assert (a.keys[0] == a.keys[1]).all() and not (a.keys[0] == a.keys[2]).all()
    assert (a.values[a.cuts[0] : a.cuts[1]] == a.values[a.cuts[1] : a.cuts[2]]).all()


def test_samples_estimate_similarity():
    r = random.Random(9)
    base = words(r, 400)
    errors = []
    for edits in (5, 20, 40):
        copy = list(base)
        for _ in range(edits):
            copy[r.randrange(len(copy))] = "zz%d" % r.randrange(10_000)
        texts = [" ".join(base).encode(), " ".join(copy).encode()]
        idf = np.full(1 << N.CELLS_LOG2, 64, dtype=np.uint8)
        values, weights, cuts, _ = N.weighted(texts, idf)
        a, b = (set(values[cuts[k] : cuts[k + 1]].tolist()) for k in (0, 1))
        drawn = N.samples(values, weights, cuts)
        errors.append((drawn[0] == drawn[1]).mean() - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.12


def test_hostile(spark, hostile, nothing):
    out = N.mark_near_duplicates(hostile)
    rows = out.collect()
    assert len(rows) == hostile.count()
    by_id = {r.doc_id: r.class_id for r in rows}
    assert by_id[1] == by_id[2] == 1 and by_id[3] == by_id[4] == 3 and by_id[None] is None
    assert set(out.columns) == set(hostile.columns)
    kept = N.deduplicate(hostile)
    assert kept.columns == hostile.columns and {r.doc_id for r in kept.collect()} == {1, 3, 5, 7, 8, 9, None}
    assert N.mark_near_duplicates(nothing).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, 200), (300, 100)] + [(7, 7)]
    got = {r.node: r.label for r in N.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 200: 100, 300: 100}
