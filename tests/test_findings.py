"""Findings of the second review: ties, copies and odd rows."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from cataloom import registry
from cataloom.operators import images, joins, neighbours, transforms
from tests.test_queries import plain


def run(spark, name, folder):
    return registry.queries()[name](spark, str(folder)).collect()


def assert_sql(spark, name, folder, *tables):
    """A query's rows are those of its SQL over the tables of a folder."""
    db = duckdb.connect()
    for t in tables:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    held = db.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in held.description]
    expected = sorted((tuple(plain(v) for v in r) for r in held.fetchall()), key=repr)
    rows = run(spark, name, folder)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr) == expected and expected
    return [r.asDict() for r in rows]


def test_last_decisions_ties_go_to_the_first_row(spark, tmp_path):
    """Lines of equal date and number, both ways round, and one without a decision."""
    lines = [(1, 1, "R"), (1, 1, "A"), (2, 1, "A"), (2, 1, "R"), (2, 0, "N"), (3, 2, None), (3, 1, "N")]
    spark.createDataFrame([(k, 0.06, n, flag) for k, n, flag in lines], "l_orderkey long, l_tax double, l_linenumber int, l_returnflag string").selectExpr("*", "timestamp'2020-01-01 00:00:00' AS l_shipdate").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert {r.o_orderkey: r.decision for r in run(spark, "last_decisions", tmp_path)} == {1: "R", 2: "A", 3: "N", 4: "pending"}


def test_last_decisions_null_dates_and_numbers_come_last(spark, tmp_path):
    """Lines without a date or a number beside those that have them, both ways round; alone; and with neither."""
    lines = [(1, None, 1, "A"), (1, "2020-01-01", 2, "R"), (2, "2020-01-01", 1, "R"), (2, None, 1, "A"), (3, "2020-01-01", None, "A"), (3, "2020-01-01", 9, "R"), (4, "2020-01-02", 1, "R"), (4, "2020-01-01", None, "A")]
    lines += [(5, None, None, "N"), (6, None, None, "A"), (6, None, 1, "R"), (7, None, None, None), (7, "2020-01-01", 1, "R")]
    spark.createDataFrame([(k, 0.06, day, n, flag) for k, day, n, flag in lines], "l_orderkey long, l_tax double, day string, l_linenumber int, l_returnflag string").selectExpr("*", "CAST(day AS TIMESTAMP) AS l_shipdate").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in range(1, 9)], "o_orderkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    rows = assert_sql(spark, "last_decisions", tmp_path, "lineitem", "orders")
    assert {r["o_orderkey"]: r["decision"] for r in rows} == {1: "A", 2: "A", 3: "A", 4: "R", 5: "N", 6: "A", 7: "R", 8: "pending"}


def test_grouped_jobs_cut_distinct_names_without_a_broadcast(spark, tmp_path):
    """A file of few bytes and many rows: the plan must not send every cut name of every row to the driver."""
    spark.range(20_000).selectExpr("CASE WHEN id % 5 = 4 THEN NULL ELSE concat('Red part ', id % 5) END AS job").coalesce(1).write.parquet(f"{tmp_path}/jobs")
    rules = spark.createDataFrame([("reds", "red-", "none"), ("one", "red-part-1", "none"), ("all", "", "none"), ("long", "red-part-1-and-more", "fallback")], "rule string, prefix string, fallback string")
    out = transforms.grouped_jobs(spark.read.parquet(f"{tmp_path}/jobs"), rules)
    names = [f"Red part {k}" for k in range(4)]
    assert {r.rule: r.jobs for r in out.collect()} == {"reds": names, "one": names[1:2], "all": names, "long": ["fallback"]}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "HashAggregate(keys=[job" in plan


def test_resolution_scores_each_title_once(spark, tmp_path):
    """Many works of few titles and many copies of entities: outcomes are those of the SQL, and the pairs of works and entities of a creator are never made."""
    parts = [(k, "blue cup" if k % 8 == 0 else f"red cup {'abcde'[k % 5]}", "b" if k % 9 else "c", f"k{k % 3}", k % 7 + 1) for k in range(400)] + [(400, "lone jar", "d", "k1", 3), (401, "lone jar", "d", "k2", 30)]
    frame = spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1)
    frame.write.parquet(f"{tmp_path}/part.parquet")
    frame.selectExpr("p_partkey AS c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("creator_matches", "holder_matches", "resolution_chain", "variant_matches"):
        assert_sql(spark, name, tmp_path, "part", "customer")
        plan = registry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [creator" in plan and "Window [count" not in plan


def test_copies_are_linked_by_class(spark, tmp_path):
    """1,200 parts of two names and some others: rows out are members and class links, not pairs of copies, and multiply out to the pairs."""
    parts = [(k, "red ring bolts" if k % 2 else "blue jar", "Brand#1", "t", k % 40) for k in range(1_200)] + [(1_200, "red ring bolts two", "Brand#1", "t", 1), (1_201, "odd cup", "Brand#2", "t", 1), (1_202, "odd cup", "Brand#2", "t", 30), (1_203, "sole", None, "t", 1)]
    spark.createDataFrame([(*p, 1.0) for p in parts], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("title_margin_match", "entity_match_ratio"):
        rows = assert_sql(spark, name, tmp_path, "part") if name == "title_margin_match" else [r.asDict() for r in run(spark, name, tmp_path)]
        members, links = ({r["id"]: r for r in rows if r["kind"] == kind} for kind in ("member", "link"))
        assert sorted(members) == [p[0] for p in parts] and len(rows) < len(parts) + 10
        assert members[0]["n_links"] == 599 and members[1]["n_links"] == 599 + (name == "title_margin_match") and members[1_203]["n_links"] == 0
        assert members[1_201]["qid"] == 1_202 and members[1_202]["qid"] == 1_201 and 1_201 in links


def test_tiered_classes_multiply_out(spark, tmp_path):
    parts = [(k, ["red ring", "blue jar", "red jar large", "cup"][k % 4], f"Brand#{k % 3}", "t", 1, 1.0) for k in range(84)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(parts[12:13], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/one/part.parquet")
    rows = assert_sql(spark, "tiered_duplicate_match", tmp_path, "part")
    side = {kind: {r["id"]: r["other_id"] for r in rows if r["kind"] == kind} for kind in ("candidate", "inventory")}
    links = {(r["id"], r["other_id"]): r for r in rows if r["kind"] == "link"}
    f = spark.read.parquet(f"{tmp_path}/part.parquet").selectExpr("p_partkey AS id", "p_name AS title", "p_brand AS artist")
    altered = f.selectExpr("id", "CASE WHEN id % 3 = 0 THEN concat(title, ' large') ELSE title END AS title", "CASE WHEN id % 7 = 0 THEN 'Other Maker' ELSE artist END AS artist")
    pairs = {(r.candidate_id, r.inventory_id): (r.tier, round(r.confidence, 6)) for r in joins.tiered_match(f, altered, ["id", "title", "artist"], ["id", "title", "artist"]).where("candidate_id <> inventory_id").collect()}
    held = {(a, b): (links[c, i]["tier"], links[c, i]["confidence"]) for a, c in side["candidate"].items() for b, i in side["inventory"].items() if a != b and (c, i) in links}
    assert held == pairs and sum(r["n_links"] for r in links.values()) == len(pairs)
    assert not any(r.kind == "link" for r in run(spark, "tiered_duplicate_match", f"{tmp_path}/one"))


def test_cosine_topk_odd_vectors_and_copies(spark, monkeypatch):
    """Blocks and slices of a few rows, copies, zero, null and infinite components, other lengths: the ranks of the plain definition."""
    monkeypatch.setattr(neighbours, "SLICE", 7)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 3)
    rows = [(i, [float((i * 37 + j * j * 11) % 19 - 9) for j in range(5)]) for i in range(40)] + [(40 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(30)] + [(80 + i, [3.0, 6.0, 9.0, 12.0, 15.0]) for i in range(10)]
    rows += [(100, [0.0] * 5), (101, None), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [1.0, 2.0]), (104, []), (105, [float("inf"), 1.0, 0.0, 0.0, 0.0]), (106, [float("nan"), 1.0, 0.0, 0.0, 0.0])]
    e = spark.createDataFrame(rows, "id long, vec array<double>")
    q = e.where("id % 4 = 0 OR id >= 100")
    expected = joins._best_matches(q.selectExpr("id AS query_id", "vec AS qv").crossJoin(e.selectExpr("id AS match_id", "vec AS cv")), 5).collect()
    out = joins.cosine_topk(q, e, 5)
    assert sorted((r.query_id, r["rank"], r.match_id, str(r.similarity)) for r in out.collect()) == sorted((r.query_id, r["rank"], r.match_id, str(r.similarity)) for r in expected)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner" not in plan


def test_equal_images_are_measured_once(monkeypatch):
    """Also when the held ones are dropped, and images of other shapes with the same bytes are others."""
    calls = []
    seen = images._Seen(lambda p: (calls.append(p.shape), float(p.sum()))[1:])
    one = np.arange(12).reshape(3, 4)
    assert [seen(p) for p in (one, one + 1, one.copy(), one.reshape(4, 3), one)] == [(66.0,), (78.0,), (66.0,), (66.0,), (66.0,)]
    assert calls == [(3, 4), (3, 4), (4, 3)]
    monkeypatch.setattr(images, "SEEN_BYTES", 2 * one.nbytes)
    assert [seen(one + k % 3)[0] for k in range(7)] == [66.0 + 12 * (k % 3) for k in range(7)] and len(seen.held) <= 2


def test_images_without_pixels_and_of_many_shapes(spark):
    shapes = [(9, 9), (32, 40), (9, 9), (12, 9), None, (0, 0)]
    made = [None if s is None else [[(x * 7 + y * (i + 1)) % 256 for x in range(s[1])] for y in range(s[0])] for i, s in enumerate(shapes)]
    got = {r.id: r for r in images.image_report(spark.createDataFrame(list(enumerate(made)), "id long, pixels array<array<int>>").coalesce(1)).collect()}
    for i, rows in enumerate(made):
        if rows:
            grey = np.array(rows)
            assert (got[i].dhash, got[i].ahash) == (f"{images.difference_hash(grey):016x}", f"{images.average_hash(grey):016x}")
            assert (got[i].laplacian_variance, got[i].high_frequency) == pytest.approx((images.laplacian_variance(grey), images.high_frequency_share(grey)))
        else:
            assert got[i].dhash is None and got[i].laplacian_variance is None
    colours = [None if rows is None else [[[v, 255 - v, v // 2] for v in line] for line in rows] for rows in made]
    palette = np.array([[0, 0, 0], [255, 255, 255], [200, 30, 30]])
    drawn = {r.id: r for r in images.dithered(spark.createDataFrame(list(enumerate(colours)), "id long, pixels array<array<array<int>>>").coalesce(1), palette).collect()}
    for i, rows in enumerate(colours):
        assert drawn[i].mean_ink == (float(images.quantise(np.array(rows, dtype=float), palette).mean()) if rows else None)
