"""Small helpers for functions that run on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task.
CHUNK = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def unused(name: str, columns: list[str]) -> str:
    """The name, made longer until it is none of the columns'."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of a binary column, one more than it has rows."""
    return np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)


def data(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and the offsets of its rows in them."""
    off = offsets(column).astype(np.int64)
    raw = column.buffers()[2]
    buf = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Runs of rows that hold ``most`` bytes in a binary column, or one longer row."""
    for batch in batches:
        off = offsets(batch.column(column)).astype(np.int64)
        row, n = 0, batch.num_rows
        while row < n:
            end = int(np.searchsorted(off, off[row] + most, "right")) - 1
            end = min(max(end, row + 1), n)
            yield batch.slice(row, end - row)
            row = end
