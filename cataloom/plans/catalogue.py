"""The reference relations over the star-schema tables, as DataFrames and as the same SQL for the oracles.

works: documents read as catalogue records. ratings: events read as rating events. inventory: parts read as an
inventory of titles and makers. Fields are made null on purpose for some rows, so that missing values are exercised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.functions.nested import blank_to_null


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tag -> the divisor of n_chars that gives it.
TAGS = {"setting:outdoor": 2, "setting:night": 3, "subject:ship": 4, "filter:death": 5, "palette:cool-toned": 7, "theme:war": 11, "setting:interior": 6}


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """work_id, title, artist, genre, year, tags, size."""
    d = table(spark, sf_dir, "documents")
    tags = F.filter(F.array(*[F.when(F.col("n_chars") % n == 0, F.lit(t)) for t, n in TAGS.items()]), lambda t: t.isNotNull())
    return d.select(
        F.col("doc_id").alias("work_id"),
        F.split("text", "\n")[0].alias("title"),
        F.when(F.col("doc_id") % 13 != 0, F.col("source")).alias("artist"),
        F.when(F.col("n_chars") % 9 != 0, F.concat(F.lit("painting/"), "lang")).alias("genre"),
        F.when(F.col("doc_id") % 11 != 0, (F.lit(1350) + F.col("doc_id") % 650).cast("int")).alias("year"),
        tags.alias("tags"),
        F.col("n_chars").alias("size"),
    )


WORKS_SQL = (
    "works AS (SELECT doc_id AS work_id, string_split(text, chr(10))[1] AS title, "
    "CASE WHEN doc_id % 13 <> 0 THEN source END AS artist, CASE WHEN n_chars % 9 <> 0 THEN 'painting/' || lang END AS genre, "
    "CASE WHEN doc_id % 11 <> 0 THEN CAST(1350 + doc_id % 650 AS INTEGER) END AS year, "
    "list_filter([" + ", ".join(f"CASE WHEN n_chars % {n} = 0 THEN '{t}' END" for t, n in TAGS.items()) + "], lambda t: t IS NOT NULL) AS tags, n_chars AS size FROM documents)"
)


def rating_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, work_id, ts (text), surface, fit, quality; each axis is null on the other's events."""
    e = table(spark, sf_dir, "events")
    score = F.floor(F.col("value") / 10).cast("int")
    return e.select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").alias("work_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("surface"),
        F.when(F.col("event_type").isin("view", "click"), score).alias("fit"),
        F.when(F.col("event_type").isin("purchase", "signup"), score).alias("quality"),
        F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("value")).alias("dwell"),
    )


RATINGS_SQL = (
    "ratings AS (SELECT event_id AS row_id, user_id AS work_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, "
    "CASE WHEN event_type <> 'error' THEN event_type END AS surface, "
    "CASE WHEN event_type IN ('view', 'click') THEN CAST(floor(value / 10) AS INTEGER) END AS fit, "
    "CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(floor(value / 10) AS INTEGER) END AS quality, "
    "CASE WHEN event_type <> 'error' THEN value END AS dwell FROM events)"
)


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rel_id, title, artist, medium, size of parts."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("rel_id"), blank_to_null(F.col("p_name")).alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("medium"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


INVENTORY_SQL = "inventory AS (SELECT p_partkey AS rel_id, p_name AS title, p_brand AS artist, p_type AS medium, p_size AS size, p_retailprice AS price FROM part)"
