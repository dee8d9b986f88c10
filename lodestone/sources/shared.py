"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The folder of each table that save() wrote.
_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Threads that write in a session, and the setting before the first of them.
_WRITERS: WeakKeyDictionary[SparkSession, tuple[int, str]] = WeakKeyDictionary()
_LOCK = Lock()
#: Rows of one part of dealt(), more or less.
PART_ROWS = 250_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and all runs on this machine, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, whose files go when the driver ends."""
    path = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}/{name}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """The setting by which a write deletes its shuffle files, as it was before once no thread of the session writes."""
    with _LOCK:
        writers, before = _WRITERS.get(spark, (0, spark.conf.get(_CLEANUP, "false")))
        _WRITERS[spark] = writers + 1, before
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            writers, before = _WRITERS.pop(spark)
            if writers > 1:
                _WRITERS[spark] = writers - 1, before
            else:
                spark.conf.set(_CLEANUP, before)


def save(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors.

    Spark deletes the shuffle files of the write when it is done.
    by: a column of few values, one folder each, so that a filter on it reads no other files.
    """
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    with _cleaning(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``save`` returned; nothing may read them, or what was made of them, any more."""
    for table in tables:
        path, context = _PLACES.pop(table), table.sparkSession.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def dealt(*tables: tuple[DataFrame, list[str]], rows: int | None = None) -> list[DataFrame]:
    """The tables dealt out by their keys into as many parts each, so many that a part of the largest has about PART_ROWS rows.

    What sorts, joins or groups them by these keys then needs no other shuffle, and memory that no larger input adds to.
    rows: of the largest, if that is known; they are counted else.
    """
    n = parts(tables[0][0].sparkSession, max(t.count() for t, _ in tables) if rows is None else rows)
    return [t.repartition(n, *keys) for t, keys in tables]


def parts(spark: SparkSession, rows: int) -> int:
    """The number of parts of dealt() for so many rows, one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // PART_ROWS))
