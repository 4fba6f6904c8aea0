"""Numpy kernels over Arrow batches for what is done to every pixel: lists are read as flat buffers, never an object a pixel."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch: a kernel holds a batch a few times over.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = int(spark.conf.get(name).rstrip("b"))
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list (or binary: a byte a value) column's rows one after the other, and each row's length."""
    if pa.types.is_binary(column.type):
        _, ends, data = column.buffers()
        at = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], np.diff(at)
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy()


def flags(column: pa.Array) -> np.ndarray:
    """The same of a column of booleans, or of bytes of 0 and 1."""
    return flat(column)[0].view(bool)


def begins(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Arrays as a list column."""
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    values = pa.array(np.concatenate(rows) if rows else np.zeros(0), type=kind)
    return pa.ListArray.from_arrays(pa.array(ends), values)


def mapped(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """``work`` on each batch of ``df``."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


class Chunks:
    """The rows of a batch of tile chunks: frames as matrices of one row a frame."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.batch = batch
        frames = batch.column("frames")
        self.counts = frames.value_lengths().to_numpy()
        parts = dict(zip([f.name for f in frames.type.value_type], frames.flatten().flatten(), strict=True))
        self.ordinals = parts["ordinal"].to_numpy()
        self.px, lengths = flat(parts["px"])
        self.edge = flags(parts["edge"])
        self.first = begins(self.counts)
        self.at = begins(lengths)
        self.sizes = lengths

    def __len__(self) -> int:
        return self.batch.num_rows

    def matrix(self, name: str, row: int) -> np.ndarray:
        """px or edge of a chunk: frames by pixels."""
        first, k = int(self.first[row]), int(self.counts[row])
        begin, size = int(self.at[first]), int(self.sizes[first])
        return getattr(self, name)[begin : begin + k * size].reshape(k, size)

    def rows(self, name: str) -> list[np.ndarray]:
        """A list column of the batch, a vector a row."""
        values, lengths = flat(self.batch.column(name))
        return np.split(values.view(bool) if name == "ok" else values, np.cumsum(lengths)[:-1])
