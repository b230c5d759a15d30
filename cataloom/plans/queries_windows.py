"""Queries over latest, trailing and best rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.operators import sets, windows
from cataloom.plans.catalogue import RATINGS_SQL, rating_events, table
from cataloom.registry import register


@register(
    "latest_per_key",
    "WIN-01 STM-02 STM-08",
    f"""WITH {RATINGS_SQL} SELECT work_id, row_id, ts, surface, fit, quality, dwell, count(*) OVER (PARTITION BY work_id) AS n_events FROM ratings QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY ts DESC, row_id DESC) = 1""",
)
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.latest_per_key(rating_events(spark, sf_dir), ["work_id"])


@register(
    "last_non_null_axis",
    "WIN-02 SRC-06",
    f"""WITH {RATINGS_SQL} SELECT work_id, arg_max(fit, row_id) FILTER (WHERE fit IS NOT NULL) AS fit, arg_max(quality, row_id) FILTER (WHERE quality IS NOT NULL) AS quality FROM ratings GROUP BY work_id""",
)
def last_non_null_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.last_non_null(rating_events(spark, sf_dir), ["work_id"], ["fit", "quality"])


@register(
    "first_event_actor",
    "WIN-03",
    """SELECT o_custkey, min(o_orderdate) AS first_ts, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS first_actor FROM orders GROUP BY o_custkey""",
)
def first_event_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.first_and_actor(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderpriority", "o_orderkey")


@register(
    "trailing_n_all_above",
    "WIN-06 STM-09",
    """SELECT event_id, user_id, count(value) OVER w = 3 AND min(value) OVER w >= 20 AS recovered FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def trailing_n_all_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.trailing_all_at_least(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 20, 3).select("event_id", "user_id", "recovered")


@register(
    "margin_rule",
    "WIN-07 WIN-05",
    """WITH s AS (SELECT p_brand, p_type, round(avg(p_retailprice), 4) AS score FROM part GROUP BY ALL),
        r AS (SELECT *, lead(score) OVER w AS next_score, row_number() OVER w AS rn FROM s WINDOW w AS (PARTITION BY p_brand ORDER BY score DESC, p_type))
        SELECT p_brand, p_type, score, next_score, CASE WHEN next_score IS NULL OR score - next_score >= 30 THEN 'margin' ELSE 'tied-fallback' END AS rule FROM r WHERE rn = 1""",
)
def margin_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.round(F.avg("p_retailprice"), 4).alias("score"))
    return windows.margin_rule(s, ["p_brand"], "score", "p_type", 30.0)


@register(
    "best_state_dedupe",
    "WIN-08 SRT-12",
    """SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_orderpriority, o_orderkey) = 1""",
)
def best_state_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return windows.best_state(o, ["o_custkey"], F.col("o_orderstatus") == "F", F.col("o_orderpriority"), "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@register(
    "rotation_index",
    "WIN-10 STM-03",
    """SELECT event_id, CAST((CAST(floor(epoch(ts) / 21600) AS BIGINT) + 3) % 7 AS BIGINT) AS slot FROM events""",
)
def rotation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", windows.rotation_index(F.lit(7), F.col("ts").cast("timestamp"), 21_600, 3).alias("slot"))


@register(
    "within_margin_cluster",
    "WIN-05 WIN-15 JOIN-13",
    """WITH b AS (SELECT o_custkey, o_orderpriority, max(o_totalprice) AS score FROM orders GROUP BY ALL), n AS (SELECT *, max(score) OVER (PARTITION BY o_custkey) AS best FROM b)
        SELECT o_custkey, o_orderpriority, score, best, count(*) OVER (PARTITION BY o_custkey) AS n_cluster FROM n WHERE score >= best - 20000""",
)
def within_margin_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.within_margin(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", "o_totalprice", 20_000.0).select("o_custkey", "o_orderpriority", F.col("o_totalprice").alias("score"), "best", "n_cluster")


@register(
    "recent_top_n",
    "SRT-02",
    f"""WITH {RATINGS_SQL} SELECT row_id, work_id, ts FROM ratings ORDER BY ts DESC, row_id DESC LIMIT 20""",
)
def recent_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rating_events(spark, sf_dir).select("row_id", "work_id", "ts").orderBy(F.desc("ts"), F.desc("row_id")).limit(20)


@register(
    "most_common_values",
    "SRT-03 AGG-02",
    """SELECT user_id, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY user_id ORDER BY n DESC, first_seen LIMIT 10""",
)
def most_common_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.most_common(table(spark, sf_dir, "events"), "user_id", "event_id", 10)


@register(
    "identifier_order",
    "SRT-17",
    """SELECT s_suppkey, row_number() OVER (ORDER BY CAST(substr('Q' || s_suppkey, 2) AS BIGINT), 'Q' || s_suppkey) AS place FROM supplier""",
)
def identifier_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Q"), F.col("s_suppkey").cast("string")).alias("qid"))
    return windows.numbered(held, sets.identifier_order(F.col("qid"))).select("s_suppkey", "place")


@register(
    "packed_sections",
    "TXT-04",
    """WITH s AS (SELECT conv_id, turn, length(text) AS n FROM conversations), u AS (SELECT *, greatest(600 - coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS room FROM s)
        SELECT conv_id, turn, CAST(least(n, room) AS BIGINT) AS taken, CASE WHEN n <= room THEN 'whole' WHEN room > 0 THEN 'truncated' ELSE 'dropped' END AS packing FROM u""",
)
def packed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("n"))
    return windows.packed_sections(s, ["conv_id"], ["turn"], "n", 600).select("conv_id", "turn", "taken", "packing")
