"""Stateful operators over small streams."""

from __future__ import annotations

from cataloom.streaming import streams


def as_stream(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return streams.tail(spark, str(path), schema)


def test_expiring_latest(spark, tmp_path):
    rows = [("k", "2024-01-02", "new"), ("k", "2024-01-01", "old"), ("j", "2024-01-01", "x")]
    stream = as_stream(spark, rows, "key string, ts string, payload string", tmp_path / "in")
    query = streams.expiring_latest(stream, 60_000).writeStream.format("memory").queryName("expiring").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start()
    assert query.awaitTermination(120)
    assert {(r.key, r.payload) for r in spark.table("expiring").collect()} == {("k", "new"), ("j", "x")}


def test_debounce(spark, tmp_path):
    rows = [("pr", 0.0, "request"), ("pr", 10.0, "request"), ("pr", 2000.0, "request"), ("pr", 2001.0, "error"), ("pr", 2002.0, "request")]
    stream = as_stream(spark, rows, "key string, at double, kind string", tmp_path / "in")
    got = streams.drain(streams.debounced(stream, 1800), "debounce", "update", str(tmp_path / "ck")).orderBy("at").collect()
    assert [r.dispatch for r in got] == [True, False, True, True]


def test_upserts_once(spark, tmp_path):
    stream = as_stream(spark, [(1, "a"), (2, "b")], "run_id long, v string", tmp_path / "in")
    seen = []
    assert streams.upsert_batches(stream, lambda batch, number: seen.append((number, batch.count())), str(tmp_path / "ck")).awaitTermination(120)
    assert seen == [(0, 2)]
