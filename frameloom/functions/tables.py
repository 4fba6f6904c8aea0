"""frame_tiles(TABLE(frames), tile): a table function for SQL that takes and gives whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession


class FrameTiles:
    """The tiles of frames (source_id, ordinal, width, height, gray), one binary value each (a byte a pixel); no tiles of a null frame."""

    def eval(self, frames: pa.RecordBatch, tile: pa.Array) -> Iterator[pa.Table]:
        size = tile[0].as_py()
        for row in frames.select(["source_id", "ordinal", "width", "height", "gray"]).to_pylist():  # a frame is one binary value
            if row["gray"] is None:
                continue
            frame = np.frombuffer(row["gray"], np.uint8).reshape(row["height"], row["width"])
            places = [(y, x) for y in range(0, row["height"], size) for x in range(0, row["width"], size)]
            n = len(places)
            yield pa.table(
                {
                    "source_id": pa.array([row["source_id"]] * n, pa.string()),
                    "ordinal": pa.array([row["ordinal"]] * n, pa.int32()),
                    "ty": pa.array([y // size for y, _ in places], pa.int32()),
                    "tx": pa.array([x // size for _, x in places], pa.int32()),
                    "px": pa.array([frame[y : y + size, x : x + size].tobytes() for y, x in places], pa.binary()),
                }
            )


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import arrow_udtf

    spark.udtf.register("frame_tiles", arrow_udtf(FrameTiles, returnType="source_id string, ordinal int, ty int, tx int, px binary"))
