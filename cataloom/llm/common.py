"""Helpers that the training-data operators share: column replacement, internal names, stable hashing, bounded Arrow batches."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.scratch import discard, written

__all__ = ["bound_batches", "discard", "fresh", "replacing", "trimmed", "unit_hash", "written"]

#: Bytes of an Arrow batch that goes to a Python worker; whole texts of any length pass through.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_DEFAULT = 64 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of an Arrow batch if it is the default, so that texts don't pile up beside the heap."""
    if spark.conf.get(_BATCH_SETTING).rstrip("b") == str(_BATCH_DEFAULT):
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def replacing(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns set; an input column of the same name, in any letter case, is replaced."""
    names = {name.lower() for name in columns}
    rest = [df[f"`{c}`"] for c in df.columns if c.lower() not in names]
    return df.select(*rest, *[value.alias(name) for name, value in columns.items()])


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, with a prefix that makes them clash with none of the columns in any letter case."""
    taken = {c.lower() for c in columns}
    prefix = "__"
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return [prefix + name for name in names]


def unit_hash(*parts: Column) -> Column:
    """A double in (0, 1] from the 64-bit hash of the parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + F.lit(1)).cast("double") / F.lit(float(1 << 53))


def trimmed(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow function whose worker hands freed memory back when a task ends: idle workers stay while later stages run."""

    @functools.wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run
