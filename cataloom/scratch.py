"""Tables written to the folder that driver and executors share, to cut long lineages."""

from __future__ import annotations

import atexit
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_held: dict[str, SparkSession] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of this application if all of it runs on this machine; else an error, since executors elsewhere couldn't read it."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"/tmp/checkpoints/{context.applicationId}"
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(root)
    return root.rstrip("/")


def written(df: DataFrame, tag: str, replaces: DataFrame | None = None) -> DataFrame:
    """df written as Parquet and read back. replaces: a table of an earlier round, deleted now that nothing needs it. The rest goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cataloom-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _held:
        atexit.register(release)
    _held[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    if replaces is not None:
        discard(replaces)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that written() returned."""
    path = _paths.pop(df, None)
    if path in _held:
        _delete(path, _held.pop(path))


def release() -> None:
    """Delete what written() has left."""
    while _held:
        _delete(*_held.popitem())


def _delete(path: str, spark: SparkSession) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; the files are scratch
        return


def folder(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder for files that are no table; deleted when the driver ends."""
    path = f"{shared_folder(spark)}/cataloom-{tag}-{uuid.uuid4().hex}"
    if not _held:
        atexit.register(release)
    _held[path] = spark
    return path


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, written by the driver."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(text.encode()))
    stream.close()
