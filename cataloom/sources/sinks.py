"""Sinks. Snapshots are written beside the old ones and committed by Spark; logs only grow; reports are collected last, when small."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.functions.dates import is_live
from cataloom.operators.transforms import upsert_runs
from cataloom.operators.windows import numbered
from cataloom.scratch import put_text


def write_snapshot(records: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """A new snapshot of records as JSON; never in place."""
    writer = records.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def append_events(events: DataFrame, path: str) -> None:
    """Append to a log; non-finite numbers are an error."""
    doubles = [c for c, kind in events.dtypes if kind in ("double", "float")]
    checked = events
    for c in doubles:
        bad = F.isnan(c) | (F.abs(c) == float("inf"))
        checked = checked.withColumn(c, F.when(bad, F.raise_error(F.lit(f"non-finite {c}")).cast("double")).otherwise(F.col(c)))
    checked.write.mode("append").json(path)


def compact_live(log: DataFrame, ts: str, now: Column, days: int, path: str) -> None:
    """A new snapshot of a log with its live records only."""
    log.where(is_live(F.col(ts), now, days)).write.mode("errorifexists").parquet(path)


def write_upserted(history: DataFrame, new: DataFrame, path: str, key: str = "run_id") -> None:
    """history with new rows in place of those with their key, as a new snapshot."""
    upsert_runs(history, new, key, (key,)).write.mode("errorifexists").json(path)


def write_report(report: DataFrame, path: str, order: Sequence[str]) -> None:
    """A small report as one headed CSV file."""
    report.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown_table(report: DataFrame, order: Sequence[str], most: int = 1_000) -> str:
    """A report of at most `most` rows as a table."""
    rows = report.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has {most} rows at most")
    lines = ["| " + " | ".join(report.columns) + " |", "|" + " --- |" * len(report.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in rows)])


def write_yaml(report: DataFrame, path: str, key: str, most: int = 1_000) -> None:
    """A report of at most `most` rows as a YAML map by key, in one file. JSON values are YAML, so none needs a package."""
    rows = report.orderBy(key).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has {most} rows at most")
    lines = [f"{json.dumps(str(r[key]))}: {json.dumps({c: r[c] for c in report.columns if c != key})}" for r in rows]
    put_text(report.sparkSession, path, "\n".join(lines) + "\n")


def emit_documents(records: DataFrame, document: Column, path: str) -> None:
    """A JSON document a line; null fields left out."""
    records.select(F.to_json(document).alias("value")).write.mode("errorifexists").text(path)


def bag_manifest(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifest lines of files (path, size, sha256), and the Oxum of the payload: bytes and count."""
    lines = files.select(F.concat_ws("  ", "sha256", "path").alias("value"))
    oxum = files.agg(F.sum("size").alias("n_bytes"), F.count("*").alias("n_files"))
    return lines, oxum.withColumn("oxum", F.concat_ws(".", F.col("n_bytes").cast("string"), F.col("n_files").cast("string")))


def export_plan(items: DataFrame, order: Sequence[str], file_format: str = "png") -> DataFrame:
    """items (title, master, ...) with skip reasons, and dense file names of those that are written."""
    if file_format.lower() in ("jpg", "jpeg", "webp"):
        raise ValueError("lossy formats change palette colours")
    reason = F.when(F.col("master").isNull(), "no-master").when(F.trim(F.coalesce("title", F.lit(""))) == "", "no-title")
    judged = items.withColumn("skipped", reason)
    name = F.concat(F.lpad(F.col("__n").cast("string"), 4, "0"), F.lit(f".{file_format}"))
    placed = numbered(judged.where("skipped IS NULL"), list(order), "__n").withColumn("file", name).drop("__n")
    return placed.unionByName(judged.where("skipped IS NOT NULL"), allowMissingColumns=True)


def feed_manifest(items: DataFrame, feed: str, order: str, fields: Sequence[str]) -> DataFrame:
    """feed, document: the items of a feed as one JSON array in order. A feed is a playlist, whose limit bounds it."""
    packed = F.array_sort(F.collect_list(F.struct(order, *[c for c in fields if c != order])))
    return items.groupBy(feed).agg(F.to_json(F.struct(F.count("*").alias("n"), packed.alias("items"))).alias("document"))


def mirror_existing(changed: DataFrame, mirror: DataFrame, key: str) -> DataFrame:
    """Changed records that a mirror holds already."""
    return changed.join(mirror.select(key).distinct(), key, "left_semi")
