"""Frames to tiles: the unit of parallelism, so that one long source spreads over the whole cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixels
from . import kernels

TILE_SCHEMA = "source_id string, ordinal int, ty int, tx int, px array<smallint>, edge array<boolean>, ok array<boolean>"
#: Tiles as kernels like them: a byte a pixel, which moves between JVM, exchanges and Python in one piece.
PACKED_SCHEMA = "source_id string, ordinal int, ty int, tx int, px binary, edge binary, ok binary"


def valid_array(width: Column, height: Column, excluded: Column | None) -> Column:
    """Per pixel of a frame: true unless inside ``excluded``, a struct of x, y, width and height (or null)."""
    places = F.sequence(F.lit(0), width * height - 1)
    if excluded is None:
        return F.transform(places, lambda i: F.lit(True))
    y = lambda i: F.floor(i / width)
    inside = lambda i: (i % width >= excluded["x"]) & (i % width < excluded["x"] + excluded["width"]) & (y(i) >= excluded["y"]) & (y(i) < excluded["y"] + excluded["height"])
    return F.transform(places, lambda i: ~F.coalesce(inside(i), F.lit(False)))


def split_tiles(frames: DataFrame, tile: int, edge_delta: int) -> DataFrame:
    """Row-major tiles of frames given as arrays; partial tiles at the right and the bottom are kept.

    ``frames`` has source_id, ordinal, width, height, px and, if pixels are masked, excluded.
    """
    excluded = F.col("excluded") if "excluded" in frames.columns else None
    full = frames.select("source_id", "ordinal", "width", "height", "px", pixels.edges(F.col("px"), F.col("width"), edge_delta).alias("edge"), valid_array(F.col("width"), F.col("height"), excluded).alias("ok"))
    rows = full.withColumn("ty", F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / tile).cast("int"))))
    rows = rows.withColumn("tx", F.explode(F.sequence(F.lit(0), F.floor((F.col("width") - 1) / tile).cast("int"))))
    h = F.least(F.lit(tile), F.col("height") - F.col("ty") * tile)
    w = F.least(F.lit(tile), F.col("width") - F.col("tx") * tile)
    part = lambda name: pixels.cut(F.col(name), F.col("width"), F.col("ty") * tile, F.col("tx") * tile, h, w).alias(name)
    return rows.select("source_id", "ordinal", "ty", "tx", part("px"), part("edge"), part("ok"))


def split_tiles_binary(frames: DataFrame, tile: int, edge_delta: int, packed: bool = False) -> DataFrame:
    """The same from frames whose gray is one binary value a frame, by a numpy kernel over Arrow batches.

    If ``packed``, px, edge and ok are binary, a byte a pixel.
    """
    masked = "excluded" in frames.columns
    columns = [F.col(c) for c in ("source_id", "ordinal", "width", "height", "gray")]
    if masked:
        columns += [F.col(f"excluded.{c}").alias(f"e_{c}") for c in ("x", "y", "width", "height")]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():  # a frame is one binary value: no object a pixel
                h, w = row["height"], row["width"]
                px = np.frombuffer(row["gray"], np.uint8).reshape(h, w)
                ok = np.ones((h, w), bool)
                if masked and row["e_x"] is not None:
                    ok[row["e_y"] : row["e_y"] + row["e_height"], row["e_x"] : row["e_x"] + row["e_width"]] = False
                edge = edge_flags(px, edge_delta)
                places = [(y, x) for y in range(0, h, tile) for x in range(0, w, tile)]
                array = (lambda cells, _: pa.array([c.tobytes() for c in cells], pa.binary())) if packed else kernels.lists
                cut = lambda a: [a[y : y + tile, x : x + tile].ravel() for y, x in places]  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict(
                    {
                        "source_id": [row["source_id"]] * len(places),
                        "ordinal": pa.array([row["ordinal"]] * len(places), pa.int32()),
                        "ty": pa.array([y // tile for y, _ in places], pa.int32()),
                        "tx": pa.array([x // tile for _, x in places], pa.int32()),
                        "px": array(cut(px if packed else px.astype(np.int16)), pa.int16()),
                        "edge": array(cut(edge), pa.bool_()),
                        "ok": array(cut(ok), pa.bool_()),
                    }
                )

    kernels.small_batches(frames.sparkSession)
    return frames.select(*columns).mapInArrow(split, PACKED_SCHEMA if packed else TILE_SCHEMA)


def edge_flags(px: np.ndarray, delta: int) -> np.ndarray:
    """Whether a pixel differs from its left or its upper neighbour by more than ``delta``."""
    wide = px.astype(np.int16)
    found = np.zeros(px.shape, bool)
    found[:, 1:] = np.abs(wide[:, 1:] - wide[:, :-1]) > delta
    found[1:] |= np.abs(wide[1:] - wide[:-1]) > delta
    return found


def crop(frames: DataFrame) -> DataFrame:
    """Frames cut to their ``roi`` (x, y, width, height); reject_code is set where it leaves the frame."""
    roi = F.col("roi")
    fits = (roi["x"] >= 0) & (roi["y"] >= 0) & (roi["width"] > 0) & (roi["height"] > 0) & (roi["x"] + roi["width"] <= F.col("width")) & (roi["y"] + roi["height"] <= F.col("height"))
    # The cut comes first: beside an alias ``width``, a lambda would take the alias for the column.
    cut = frames.withColumn("px", F.when(fits, pixels.cut(F.col("px"), F.col("width"), roi["y"], roi["x"], roi["height"], roi["width"])))
    return cut.select(
        *(c for c in frames.columns if c not in ("px", "width", "height", "roi", "reject_code")),
        "px",
        F.when(fits, roi["width"]).alias("width"),
        F.when(fits, roi["height"]).alias("height"),
        F.when(~fits, F.lit("InvalidRegion")).alias("reject_code"),
    )
