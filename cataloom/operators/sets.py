"""Set operations and orders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Frames of different columns by name; what one lacks is null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def first_of_each(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row in order of each key; rows without a key stand by their canonical JSON."""
    keyed = rows.withColumn("__key", F.coalesce(key, F.to_json(F.struct(*[c for c in rows.columns if c != order]))))
    picked = keyed.groupBy("__key").agg(F.min_by(F.struct(*rows.columns), order).alias("r"))
    return picked.select("r.*")


def difference_both_ways(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side: what only the left and what only the right holds."""
    left = a.select(key).distinct().exceptAll(b.select(key).distinct()).withColumn("side", F.lit("left"))
    return left.unionByName(b.select(key).distinct().exceptAll(a.select(key).distinct()).withColumn("side", F.lit("right")))


def deep_merge(rows: DataFrame, key: str, longest: Sequence[str], first: Sequence[str], most_restrictive: Mapping[str, Mapping[str, int]], unite: Sequence[str], order: str) -> DataFrame:
    """One row a key: the longest string, the first non-null value, the most restrictive value by rank, or the united set, by field."""
    aggs = [F.max_by(c, F.struct(F.length(c), -F.col(order))).alias(c) for c in longest]
    aggs += [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first]
    for c, ranks in most_restrictive.items():
        rank = F.lit(None).cast("int")
        for value, level in ranks.items():
            rank = F.when(F.col(c) == value, level).otherwise(rank)
        aggs.append(F.min_by(c, rank).alias(c))
    aggs += [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in unite]
    return rows.groupBy(key).agg(*aggs)


def page(rows: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """A page in a total order. Deep pages should seek by the last key instead; see after_key()."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def after_key(rows: DataFrame, key: str, last: object, limit: int) -> DataFrame:
    """The page after a key, without sorting what comes before it."""
    return (rows if last is None else rows.where(F.col(key) > F.lit(last))).orderBy(key).limit(limit)


def most_common(rows: DataFrame, column: str, arrival: str, k: int) -> DataFrame:
    """The k most frequent values; of equal ones the first seen."""
    return rows.groupBy(column).agg(F.count("*").alias("n"), F.min(arrival).alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(k)


def identifier_order(qid: Column) -> list[Column]:
    """By the number behind the letter, then as text."""
    return [F.substring(qid, F.lit(2), F.length(qid)).try_cast("bigint").asc_nulls_last(), qid]


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows that a seed fixes, whatever their order or partitioning."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def hot_spots_first(rows: DataFrame, missing: str, total: str, name: str, k: int) -> DataFrame:
    """Rows with anything missing, the most first; if none has, the largest."""
    any_missing = rows.agg(F.max(missing).alias("__most"))
    ranked = rows.join(F.broadcast(any_missing))
    return ranked.where((F.col("__most") <= 0) | (F.col(missing) > 0)).orderBy(F.when(F.col("__most") > 0, F.col(missing)).otherwise(F.col(total)).desc(), name).limit(k).drop("__most")


def ranked_sources(rows: DataFrame, keys: Sequence[str], score: str, name: str) -> DataFrame:
    """rows with rank by score, non-finite ones last."""
    ok = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(ok.desc(), F.col(score).desc(), F.col(name))))
