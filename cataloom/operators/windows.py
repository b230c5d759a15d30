"""Latest, first, best and trailing rows per key. All orders are total, so that ties have one outcome."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cataloom.scratch import written


def latest_per_key(events: DataFrame, keys: Sequence[str], ts: str = "ts", tie: str = "row_id") -> DataFrame:
    """The event of each key with the greatest timestamp as text; of equal ones the later row. One aggregate, no sort."""
    rest = [c for c in events.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("latest")
    return events.groupBy(*keys).agg(latest, F.count("*").alias("n_events")).select(*keys, "latest.*", "n_events")


def last_non_null(events: DataFrame, keys: Sequence[str], axes: Sequence[str], tie: str = "row_id") -> DataFrame:
    """The last non-null value of each axis in row order."""
    held = [F.max_by(a, F.when(F.col(a).isNotNull(), F.col(tie))).alias(a) for a in axes]
    return events.groupBy(*keys).agg(*held)


def first_and_actor(events: DataFrame, keys: Sequence[str], ts: str, actor: str, tie: str) -> DataFrame:
    """The least timestamp of each key and the actor of the first row that has it."""
    return events.groupBy(*keys).agg(F.min(ts).alias("first_ts"), F.min_by(actor, F.struct(ts, tie)).alias("first_actor"))


def trailing_all_at_least(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, least: float, n: int) -> DataFrame:
    """rows with recovered: whether the last n values up to each row are all at least `least`."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)
    return rows.withColumn("recovered", (F.count(value).over(w) == n) & (F.min(value).over(w) >= least))


def margin_rule(rows: DataFrame, keys: Sequence[str], score: str, name: str, margin: float) -> DataFrame:
    """The best row of each key, and whether it leads the next by the margin. Non-finite scores come last."""
    finite = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    w = Window.partitionBy(*keys).orderBy(finite.desc(), F.col(score).desc(), F.col(name))
    ranked = rows.withColumn("rank", F.row_number().over(w)).withColumn("next_score", F.lead(score).over(w)).where("rank = 1")
    rule = F.when(F.col("next_score").isNull() | (F.col(score) - F.col("next_score") >= margin), "margin").otherwise("tied-fallback")
    return ranked.withColumn("rule", rule).drop("rank")


def best_state(rows: DataFrame, keys: Sequence[str], present: Column, priority: Column, tie: str) -> DataFrame:
    """One row a key: present ones first, then by priority, then the first."""
    w = Window.partitionBy(*keys).orderBy(present.desc(), priority, F.col(tie))
    return rows.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def within_margin(rows: DataFrame, keys: Sequence[str], entity: str, score: str, margin: float) -> DataFrame:
    """The best score of each entity, and of those all within a margin of the key's best, with the size of that cluster."""
    best = rows.groupBy(*keys, entity).agg(F.max(score).alias(score))
    w = Window.partitionBy(*keys)
    near = best.withColumn("best", F.max(score).over(w)).where(F.col(score) >= F.col("best") - margin)
    return near.withColumn("n_cluster", F.count("*").over(w))


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], wanted: Column, width: int = 4) -> DataFrame:
    """The wanted rows with a dense sequence number and its padded label."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = rows.where(wanted).withColumn("seq", F.row_number().over(w))
    return out.withColumn("label", F.lpad(F.col("seq").cast("string"), width, "0"))


def rotation_index(n_items: Column, ts: Column, seconds: int, offset: int = 0) -> Column:
    """Which of n items is shown in the clock window of ts."""
    return F.when(n_items > 0, F.pmod(F.floor(F.unix_seconds(ts) / seconds) + offset, n_items))


def series_order(rows: DataFrame, keys: Sequence[str], position: str, arrival: str) -> DataFrame:
    """rows with place: explicit positions first, then rows without one as they came."""
    valid = F.when(F.col(position) > 0, F.col(position))
    w = Window.partitionBy(*keys).orderBy(valid.isNull(), F.coalesce(valid, F.col(arrival)), F.col(arrival))
    return rows.withColumn("place", F.row_number().over(w))


def top_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key; none for k below 1."""
    if k < 1:
        return rows.limit(0).withColumn("rank", F.lit(0))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def packed_sections(sections: DataFrame, keys: Sequence[str], order: Sequence[str], tokens: str, budget: int) -> DataFrame:
    """sections with how many of their tokens fit into a budget that earlier sections use up first."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(tokens).over(w), F.lit(0))
    left = F.greatest(F.lit(budget) - used, F.lit(0))
    packed = sections.withColumn("taken", F.least(F.col(tokens), left))
    return packed.withColumn("packing", F.when(F.col("taken") == F.col(tokens), "whole").when(F.col("taken") > 0, "truncated").otherwise("dropped"))


#: Rows that one task sorts for running totals; more are sorted over range partitions.
ONE_TASK_ROWS = 100_000


def running_totals(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], totals: Mapping[str, Column]) -> DataFrame:
    """rows with running totals per key in an order that is total. No task sorts more than ONE_TASK_ROWS of a key.

    Beyond that, rows are sorted over range partitions and written; a total is that within the partition plus what the
    earlier partitions of the key hold, of which there is one row a partition and key.
    """
    place, part = "__running_place", "__running_part"
    base = written(rows.select("*", *[value.alias(name) for name, value in totals.items()]), "running")
    if base.count() <= ONE_TASK_ROWS:
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return base.select(*rows.columns, *[F.sum(name).over(whole).alias(name) for name in totals])
    held = base.orderBy(*keys, *order)
    held = written(held.withColumn(place, F.monotonically_increasing_id()), "running").withColumn(part, F.shiftright(place, 33))
    per_part = held.groupBy(part, *keys).agg(*[F.sum(name).alias(name) for name in totals])
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(F.col(part).alias("__key_part"), *[F.col(k).alias(f"__key_{k}") for k in keys], *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"__before_{name}") for name in totals])
    joined = held.join(offsets, [held[part] == F.col("__key_part"), *[held[k].eqNullSafe(F.col(f"__key_{k}")) for k in keys]])
    within = Window.partitionBy(part, *keys).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(*rows.columns, *[(F.sum(name).over(within) + F.col(f"__before_{name}")).alias(name) for name in totals])


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str = "place", keys: Sequence[str] = ()) -> DataFrame:
    """rows with their number from 1, per key if there are any, in a total order."""
    return running_totals(rows, keys, order, {name: F.lit(1)})


def first_seen_mode(rows: DataFrame, keys: Sequence[str], value: str, arrival: str) -> DataFrame:
    """Per key the most frequent value; of equally frequent ones that seen first, then the least."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("__n"), F.min(arrival).alias("__first"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), "__first", value)).alias(value))
