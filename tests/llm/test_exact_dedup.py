"""Tries against dictionaries; whole-table results against groupings."""

from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from cataloom.llm import exact_dedup as E


def test_trie_holds_what_a_dictionary_holds():
    r = random.Random(5)
    for _ in range(50):
        trie, plain = E.PatriciaTrie(), {}
        for _ in range(200):
            key = bytes(r.choice(b"ab") for _ in range(r.randrange(0, 12)))
            owner = r.randrange(100)
            trie.insert(key, owner)
            plain.setdefault(key, []).append(owner)
        found = dict(trie.terminals())
        assert found.keys() == plain.keys()
        for key, (owner, owner_rows, n_rows, _) in found.items():
            assert (owner, owner_rows, n_rows) == (min(plain[key]), plain[key].count(min(plain[key])), len(plain[key]))


def total(trie):
    order, n = [trie.root], 0
    for node in order:
        order.extend(node[1].values())
        n += 0 if node is trie.root else len(node[0]) + E.NODE_BYTES
    return n


def test_subtrees_are_handed_on_once():
    """What spills and what stays make up everything; the bytes left are what they are said to be."""
    r = random.Random(7)
    for _ in range(60):
        trie, plain = E.PatriciaTrie(), {}
        for i in range(150):
            key = bytes(r.choice(b"abc") for _ in range(r.randrange(0, 9)))
            trie.insert(key, i)
            plain[key] = plain.get(key, 0) + 1
        most = r.choice([0, 1_000, 5_000, 20_000, 10**6])
        before, gone = trie.size_bytes, [(k, t[2]) for k, t in trie.spill(most)]
        assert before == 0 or trie.size_bytes <= max(most, 0) and trie.size_bytes == total(trie)
        left = [(k, t[2]) for k, t in trie.terminals()]
        assert len({k for k, _ in gone + left}) == len(gone + left) and dict(gone + left) == plain
        if most >= before:
            assert not gone


def test_spilling_changes_nothing(spark, monkeypatch):
    """The reduce side hands subtrees on between strings; the map side may hand a text on in parts."""
    r = random.Random(8)
    texts = ["".join(r.choice("ab") for _ in range(r.randrange(1, 7))) for _ in range(600)]
    monkeypatch.setattr(E, "TRIE_BYTES", 2_000)
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in (([*range(600)], pa.int64()), ([len(t) for t in texts], pa.int64()), ([0] * 600, pa.int64()), (texts, pa.string()), ([t.encode() for t in texts], pa.binary()))], names=["id", "n_bytes", "h", "sha", "body"])
    parts = pa.Table.from_batches(E._combine(iter([batch])))
    assert parts.num_rows > len(set(texts)), "some texts left in parts"
    owned = [x for b in E._own(iter(parts.sort_by("body").to_batches(max_chunksize=50))) for x in b.to_pylist()]
    assert {x["sha"]: (x["keep_id"], x["group_size"]) for x in owned} == {t: (texts.index(t), texts.count(t)) for t in texts} and len(owned) == len(set(texts))


def test_largest_identifier_and_partly_dropped_ones(spark):
    top = (1 << 63) - 1
    rows = [(top, "a"), (None, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "b"), (4, "d"), (4, "d"), (None, "e"), (None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__own", F.lit("x"))
    kept = sorted((x.doc_id or 0, x.text) for x in E.deduplicate(docs).collect())
    assert kept == [(0, "e"), (1, "b"), (2, "c"), (4, "d"), (top, "a")]
    assert {x.keep_id for x in E.mark_duplicates(docs).where("text = 'a'").collect()} == {top}
    simple = docs.where("doc_id < 2 OR doc_id = 3")
    assert sorted(x.doc_id for x in E.deduplicate(simple).collect()) == [1] and E.deduplicate(simple).columns == docs.columns


def test_depth_is_no_limit():
    trie = E.PatriciaTrie()
    for n in range(5000):
        trie.insert(b"a" * n, n)
    assert sum(1 for _ in trie.terminals()) == 5000


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def test_marks(hostile):
    rows = E.mark_duplicates(hostile).collect()
    source = hostile.collect()
    assert len(rows) == len(source)
    groups = {}
    for x in source:
        groups.setdefault(normal(x.text), []).append(x.doc_id)
    for x in rows:
        ids = groups[normal(x.text)]
        known = [i for i in ids if i is not None]
        assert x.keep_id == (min(known) if known else None) and x.group_size == len(ids)
        assert x.text_sha256 == hashlib.sha256(normal(x.text).encode()).hexdigest()
    kept = [x for x in rows if x.kept]
    assert len(kept) == len(groups) and all(x.doc_id == x.keep_id for x in kept)
    assert {c for c in hostile.columns} - {"kept", "keep_id"} <= set(rows[0].__fields__)


def test_deduplicate_keeps_columns(hostile, nothing):
    out = E.deduplicate(hostile)
    assert out.columns == hostile.columns and {r.kept for r in out.collect()} == {-7}
    assert E.mark_duplicates(nothing).count() == 0


def test_hot_text(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot text' ELSE concat('t', id) END AS text")
    rows = E.mark_duplicates(docs).where("text = 'hot text'").collect()
    assert len(rows) == 1000 and {(r.keep_id, r.group_size) for r in rows} == {(0, 1000)} and sum(r.kept for r in rows) == 1
