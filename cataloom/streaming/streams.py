"""Structured Streaming: event-log tails, latest state, deduplication, clock and session windows, state with expiry."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tail(spark: SparkSession, path: str, schema: str, file_format: str = "parquet", files_per_batch: int = 8, **options: str) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).format(file_format).option("maxFilesPerTrigger", files_per_batch).options(**options).load(path)


def latest_state(events: DataFrame, keys: Sequence[str], ts: str, tie: str) -> DataFrame:
    """The latest event of each key, kept up to date."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("latest"), F.count("*").alias("n_events")).select(*keys, "latest.*", "n_events")


def first_deliveries(events: DataFrame, keys: Sequence[str], ts: str, late: str) -> DataFrame:
    """Each key once; its state goes when the watermark has passed."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def tumbling(events: DataFrame, ts: str, size: str, late: str, keys: Sequence[str] = (), slide: str | None = None) -> DataFrame:
    """Counts and sums of value by clock window."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, late: str, keys: Sequence[str]) -> DataFrame:
    """Counts by session: events of a key with no gap as long as `gap`."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), *keys, "n")


def expiring_latest(events: DataFrame, ttl_ms: int) -> DataFrame:
    """key, ts, payload: the latest payload of each key of events (key, ts, payload), forgotten when it has been silent for ttl_ms of processing time."""

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = state.get if state.exists else ("", None)
        for frame in frames:
            for ts, payload in zip(frame["ts"], frame["payload"], strict=True):
                if ts >= best[0]:
                    best = (ts, payload)
        state.update(best)
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"key": [str(key[0])], "ts": [best[0]], "payload": [best[1]]})

    return events.groupBy("key").applyInPandasWithState(keep, "key string, ts string, payload string", "ts string, payload string", "update", GroupStateTimeout.ProcessingTimeTimeout)


def debounced(requests: DataFrame, pending_seconds: float) -> DataFrame:
    """key, at, dispatch for each request of (key, at, kind): a first one goes out, one after an error, or one whose pending predecessor has timed out."""

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, since = state.get if state.exists else (None, 0.0)
        out = []
        for frame in frames:
            for at, kind in zip(frame["at"], frame["kind"], strict=True):
                if kind != "request":
                    status, since = kind, at
                    continue
                go = status in (None, "error") or (status == "pending" and at - since >= pending_seconds)
                out.append((str(key[0]), at, go))
                if go:
                    status, since = "pending", at
        state.update((status, float(since)))
        yield pd.DataFrame(out, columns=["key", "at", "dispatch"])

    return requests.groupBy("key").applyInPandasWithState(decide, "key string, at double, dispatch boolean", "status string, since double", "update", GroupStateTimeout.NoTimeout)


def upsert_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each batch once to an idempotent writer: batches that come again carry the same number."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> DataFrame:
    """All that is available now, through an in-memory table; for small results and tests."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


class _BudgetSpent(Exception):
    pass


def budgeted(spark: SparkSession, path: str, schema: str, files: int, checkpoint: str, out: str, batches: int = 1) -> int:
    """Work on new files where the checkpoint says the last run ended, `files` a batch; the number of batches done.

    The batch beyond the budget is refused, so it isn't committed and comes first in the next run. Each batch is a folder
    of its own, written anew if it comes again.
    """
    done: list[int] = []

    def work(batch: DataFrame, number: int) -> None:
        if len(done) >= batches:
            raise _BudgetSpent
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        done.append(number)

    query = upsert_batches(tail(spark, path, schema, files_per_batch=files), work, checkpoint)
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if len(done) < batches:
            raise
    return len(done)
