"""Queries over whole tables, on tables larger than those of the other tests."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cataloom import registry
from cataloom.operators import joins, preferences
from tests.test_queries import TABLES, plain

LARGER = "/root/testdata/sf0.01"


def against_oracle(spark, name, folder=LARGER):
    """Rows of a query and those of its oracle, both over a folder of tables."""
    out = registry.queries()[name](spark, folder)
    rows = [tuple(plain(r[c]) for c in sorted(out.columns)) for r in out.collect()]
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    held = db.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in held.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(rows, key=repr), sorted((tuple(plain(r[i]) for i in order) for r in held.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["known_works_merge", "uniqueness_guard", "variant_edges", "bt_components", "embedding_topk"])
def test_oracle_beyond_the_ranges(spark, name):
    rows, expected = against_oracle(spark, name)
    assert rows == expected and rows


def test_every_part_and_supplier_counts(spark):
    q = registry.queries()
    merged = q["known_works_merge"](spark, LARGER)
    names = spark.read.parquet(f"{LARGER}/part.parquet").selectExpr("lower(p_name) AS key").distinct()
    assert names.join(merged, "key", "left_anti").count() == 0
    guarded = q["uniqueness_guard"](spark, LARGER)
    assert guarded.count() == spark.read.parquet(f"{LARGER}/part.parquet").where("p_size % 5 <> 0").count()
    assert {r.outcome for r in guarded.select("outcome").distinct().collect()} == {"held", "assigned", "contested"}
    verdicts = q["variant_edges"](spark, LARGER)
    assert verdicts.selectExpr("max(owner)").first()[0] > 93 and verdicts.where("verdict IN ('mutual', 'self')").count() > 0


def test_diverse_selection_over_every_embedding(spark):
    e = spark.read.parquet(f"{LARGER}/embeddings.parquet").toPandas()
    e = pd.DataFrame({"id": e.vec_id, "quality": 0.5 + e.vec_id % 10 / 20, "vec": [[float(x) for x in v] for v in e.embedding], "label": e.label})
    expected = {(label, r.place, r.id) for label, rows in e.groupby("label") for r in preferences.diverse_subset(rows, 5).itertuples()}
    assert any(i >= 400 for _, _, i in expected)
    assert {(r.label, r.place, r.id) for r in registry.queries()["diverse_selection"](spark, LARGER).collect()} == expected


def test_diverse_rounds_are_the_subset(spark, monkeypatch):
    """Groups too large for a task: equal picks, a null group, groups of fewer than k items, ties."""
    rows = [(i, 0.5 + i * 7 % 10 / 20, [float((i * 37 + j * j * 11) % 19 - 9) for j in range(6)], None if i % 4 == 0 else i % 4) for i in range(60)]
    rows += [(100, 0.5, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], 9), (101, 0.5, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], 9)]
    frame = spark.createDataFrame(rows, "id long, quality double, vec array<double>, label int")
    expected = {}
    for label in (None, 1, 2, 3, 9):
        part = pd.DataFrame([r[:3] for r in rows if r[3] == label], columns=["id", "quality", "vec"])
        expected |= {(label, r.place): (r.id, r.quality_part, None if pd.isna(r.nearest) else round(r.nearest, 9), round(r.determinant, 9)) for r in preferences.diverse_subset(part, 5).itertuples()}
    monkeypatch.setattr(preferences, "FIT_ITEMS", 1)
    got = {(r.label, r.place): (r.id, r.quality_part, None if r.nearest is None else round(r.nearest, 9), round(r.determinant, 9)) for r in preferences.select_diverse(frame, "label", 5).collect()}
    assert got == expected
    with pytest.raises(ValueError, match="finite"):
        preferences.select_diverse(frame.withColumn("quality", F.lit(-1.0)), "label", 5)


def test_image_kernels_over_every_part(spark):
    assert registry.queries()["image_kernels"](spark, LARGER).count() == spark.read.parquet(f"{LARGER}/part.parquet").count()


def test_components_hold_every_supplier(spark):
    nodes = registry.queries()["bt_components"](spark, LARGER).select("node")
    assert spark.read.parquet(f"{LARGER}/supplier.parquet").selectExpr("s_suppkey AS node").join(nodes, "node", "left_anti").count() == 0


def test_unknown_blocks_meet_everything(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], None), (3, [1.0, 0.1], "b"), (4, [0.0, 1.0], ""), (5, [0.9, 0.1], "a")]
    e = spark.createDataFrame(rows, "id long, vec array<double>, artist string")

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    expected = {(i, j, rank) for i, v, block in rows for rank, j in enumerate(sorted((r[0] for r in rows if r[0] != i and not (block and r[2] and block != r[2])), key=lambda j: (-cosine(v, rows[j - 1][1]), j))[:3], 1)}
    assert {(r.query_id, r.match_id, r["rank"]) for r in joins.blocked_cosine_topk(e, e, "artist", 3).collect()} == expected
    assert (2, 1, 1) in expected and (1, 2, 1) in expected


def test_same_side_duplicates_meet(spark, tmp_path):
    """Ids 13 and 23, equal texts on one side of the old split; parts that no old filter lets meet."""
    docs = [(13, "an equal text", "s"), (23, "an equal text", "s"), (30, "x" * 35 + " one", "t"), (40, "y" * 35 + " two", "u")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "red ring bolts", "b", 5), (2, "red ring bolts", "b", 5), (3, "blue", "c", 5)], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    q = registry.queries()
    layered = {r.candidate_id: (r.archive_id, r.layer) for r in q["layered_dedup"](spark, str(tmp_path)).collect()}
    assert layered[13] == (23, "digest") and layered[23] == (13, "digest")
    assert {(r.id, r.qid) for r in q["title_margin_match"](spark, str(tmp_path)).collect() if r.qid is not None} == {(1, 2), (2, 1)}
    assert {(r.id, r.qid): r.score for r in q["entity_match_ratio"](spark, str(tmp_path)).collect() if r.qid is not None} == {(1, 2): 1.0, (2, 1): 1.0}
