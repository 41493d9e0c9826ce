"""Registry of the training-data queries and small helpers that several operators use."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from catalumen.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Arrow sends at most this many rows to Python at once; texts are long, so the
# default of 10,000 rows would need far more memory than a task should hold.
ROWS_PER_BATCH = 1_000


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL twin where SQL can express it."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in the shared folder, so that later plans read it instead of repeating it."""
    return cut_lineage(df, purpose)


def small_batches(spark: SparkSession) -> None:
    """Hold the rows of one Arrow batch down; only ever lowers the session's own setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


def row_slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of whole rows whose ``column`` holds about ``most_bytes``, or one longer row."""
    sizes = np.diff(offsets(batch.column(column)))
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of a binary or string column; a null counts as empty."""
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * kind().itemsize)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the column in a row, and where each entry starts (one more than there are rows)."""
    at = offsets(column).astype(np.int64)
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]
