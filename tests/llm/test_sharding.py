"""Shares, gapless slots, and movement confined to what grew."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from cataloom.llm import sharding as S


def test_growth_moves_rows_only_into_the_new_shard(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "k")
    for n in (8, 9, 12):
        moved = S.assign_shards(rows, "k", S.tree_for(n), S.tree_for(n + 1)).where("shard <> grown_shard")
        assert {r.grown_shard for r in moved.select("grown_shard").distinct().collect()} == {n}
    counts = [r["count"] for r in S.assign_shards(rows, "k", S.tree_for(8)).groupBy("shard").count().collect()]
    assert len(counts) == 8 and max(counts) < 1.15 * 2500 and min(counts) > 0.85 * 2500


def test_weights_give_shares_and_confine_movement(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "k")
    tree = S.tree_for(8)
    heavier = tree.with_shard(0, 0, 0, 3.0)
    both = S.assign_shards(rows, "k", tree, heavier)
    moved = both.where("shard <> grown_shard")
    # Between regions rows go to region 0 only, between its racks to rack 0 only, and within rack 0 to shard 0 only.
    assert moved.where("shard > 3 AND grown_shard > 3").count() == 0
    assert moved.where("shard IN (2, 3) AND grown_shard NOT IN (0, 1)").count() == 0
    assert moved.where("shard = 0").count() == 0
    assert both.where("grown_shard = 0").count() > 1.8 * both.where("shard = 0").count()
    none = S.assign_shards(rows, "k", tree.with_shard(1, 2, 4, 0.0))
    assert none.where("shard = 4").count() == 0


def test_no_tree_below_its_base(spark):
    with pytest.raises(ValueError):
        S.tree_for(7)
    rows = spark.range(20_000).withColumnRenamed("id", "k")
    for n in (3, 4, 7):  # smaller base blocks keep the law
        moved = S.assign_shards(rows, "k", S.tree_for(n, base=3), S.tree_for(n + 1, base=3)).where("shard <> grown_shard")
        assert {r.grown_shard for r in moved.select("grown_shard").distinct().collect()} == {n}


def test_descent_against_brute_force(spark):
    """Every draw of every child, level by level, from the same hashes."""
    tree = S.tree_for(8).with_shard(0, 1, 3, 2.5).with_shard(7, 9, 30, 0.5)
    keys = [f"k{i}" for i in range(300)]
    names = sorted({c for level in tree.levels() for children in level.values() for c, _ in children})
    frame = spark.createDataFrame([(k,) for k in keys], "k string")
    hashed = frame.select("k", *[S.unit_hash(F.lit(0), F.lit(d), F.lit(c).cast("long"), F.col("k")).alias(f"u{d}_{c}") for d in range(3) for c in names]).collect()
    got = {r.k: r.shard for r in S.assign_shards(frame, "k", tree).collect()}
    for row in hashed:
        at = -1
        for depth, level in enumerate(tree.levels()):
            at = min((-math.log(row[f"u{depth}_{c}"]) / w, c) for c, w in level[at] if w > 0)[1]
        assert got[row.k] == at


def test_clashing_names(spark):
    rows = spark.range(50).selectExpr("id AS k", "1 AS __bucket", "2 AS __row", "3 AS __before", "4 AS __n")
    out = S.number_slots(S.assign_shards(rows, "k", S.tree_for(8)), ["k"])
    assert sorted(out.columns) == sorted([*rows.columns, "shard", "slot"]) and {(r["__bucket"], r["__row"], r["__before"]) for r in out.collect()} == {(1, 2, 3)}


def test_slots_are_gapless(spark):
    rows = S.assign_shards(spark.range(5000).withColumnRenamed("id", "k"), "k", S.tree_for(8))
    slots = S.number_slots(rows, ["k"], rows_per_bucket=100)
    per = slots.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("d"), F.min("slot").alias("lo"), F.max("slot").alias("hi")).collect()
    assert all(r.n == r.d == r.hi + 1 and r.lo == 0 for r in per) and sum(r.n for r in per) == 5000


def test_hostile(hostile, nothing):
    out = S.number_slots(S.assign_shards(hostile, "doc_id", S.tree_for(8), S.tree_for(9)), ["doc_id", "text"])
    assert out.count() == hostile.count() and out.where("shard < 0 OR slot < 0").count() == 0
    assert out.where("doc_id = 1").select("shard").distinct().count() == 1
    assert S.number_slots(S.assign_shards(nothing, "doc_id", S.tree_for(8)), ["doc_id"]).count() == 0


def test_write(spark, hostile, tmp_path):
    S.write_shards(hostile.select("doc_id", "text"), f"{tmp_path}/out", S.tree_for(8))
    assert spark.read.parquet(f"{tmp_path}/out").count() == hostile.count()
