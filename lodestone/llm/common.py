"""What the operators share: tables, the shared folder, Arrow batches and flat text.

Every operator selects the columns it needs by name before it adds its own, so
extra columns of the input never clash with working columns.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.sources.shared import save, shared_dir

__all__ = ["column", "flat", "in_rows", "lists", "release", "save", "shared_dir", "small_batches", "table"]

_libc = ctypes.CDLL(ctypes.util.find_library("c"))
_libc = _libc if hasattr(_libc, "malloc_trim") else None

#: Rows and bytes in one Arrow batch. Texts are long, so batches stay well below Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 1024, "4m"


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, so that a Python worker holds little at a time; a longer row stands alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark alone. The session's Arrow batches are small from then on."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give memory that is free back to the system: a worker that waits for its next task should hold little."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def in_rows(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``most_bytes`` bytes in each; one longer text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows in one array, and the n + 1 offsets of the rows; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(buffers[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, type=kind))
