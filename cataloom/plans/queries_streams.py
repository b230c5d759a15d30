"""Queries that run a stream over what is available and return its table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.scratch import shared_folder, written
from cataloom.registry import register
from cataloom.streaming import streams

_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream with zoned time."""
    raw = streams.tail(spark, sf_dir, _SCHEMA, pathGlobFilter="events.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """The stream's table, by an in-memory sink, as a written table."""
    name = f"s_{uuid.uuid4().hex}"
    spark = stream.sparkSession
    shown = streams.drain(stream, name, mode, f"{shared_folder(spark)}/{name}")
    out = written(shown, name)
    spark.catalog.dropTempView(name)
    return out


@register(
    "stream_latest_state",
    "STM-01 STM-02",
    """SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value, count(*) AS n_events FROM events GROUP BY user_id""",
)
def stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = streams.latest_state(_events(spark, sf_dir).select("user_id", "event_id", "ts", "value"), ["user_id"], "ts", "event_id")
    return _drained(latest.select("user_id", "event_id", "value", "n_events"), "complete")


@register("stream_dedupe", "STM-05", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = streams.first_deliveries(_events(spark, sf_dir), ["user_id", "event_type"], "ts", "60 days")
    return _drained(first.select("user_id", "event_type"), "append")


@register(
    "stream_tumbling",
    "STM-03 STM-09",
    """SELECT to_timestamp(floor(epoch(ts) / 21600) * 21600)::TIMESTAMP AS w_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
)
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = streams.tumbling(_events(spark, sf_dir), "ts", "6 hours", "1 day", ["event_type"])
    out = _drained(windows, "complete")
    return out.select(F.col("w_start").cast("timestamp_ntz").alias("w_start"), "event_type", "n", F.round("total", 4).alias("total"))


@register(
    "stream_session",
    "STM-09 STM-08",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, min(ts) AS w_start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = streams.sessions(_events(spark, sf_dir), "ts", "12 hours", "1 day", ["user_id"])
    out = _drained(sessions, "complete")
    return out.select("user_id", F.col("w_start").cast("timestamp_ntz").alias("w_start"), "n")
