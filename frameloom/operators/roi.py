"""Regions of interest from the brightness of a source's first frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rational import div_ceil, div_floor
from ..settings import BLACK_LEVEL
from . import kernels

FIRST_FRAMES = 8
LEAST_SHARE = 0.25
#: Pixels that are counted at once: 256 bins each.
COUNTED = 1 << 14


def first_rows(samples: DataFrame, n: int, order: str = "ordinal") -> DataFrame:
    """The first n rows of each source (a bound on each source, unlike a limit)."""
    place = "_place"
    return samples.withColumn(place, F.row_number().over(Window.partitionBy("source_id").orderBy(order))).where(F.col(place) <= n).drop(place)


def counting_median(rows: np.ndarray, bins: int = 256) -> np.ndarray:
    """Twice the median of each column of whole numbers below ``bins``, exactly: the two middle values are found by counting, not by sorting."""
    n, width = rows.shape
    out = np.empty(width, np.int64)
    for at in range(0, width, COUNTED):
        part = rows[:, at : at + COUNTED].astype(np.int64)
        own = part.shape[1]
        upto = np.bincount((np.arange(own) * bins + part).ravel(), minlength=own * bins).reshape(own, bins).cumsum(axis=1)
        out[at : at + own] = (upto >= (n + 1) // 2).argmax(axis=1) + (upto >= n // 2 + 1).argmax(axis=1)
    return out


def median_images(frames: DataFrame, n: int = FIRST_FRAMES) -> DataFrame:
    """(source_id, width, height, twice): one row a source, per pixel twice the median of its first n frames, as 16-bit integers.

    Frames are px (array) or gray (a byte a pixel). A group is streamed; it holds n frames at most.
    """
    px = "gray" if "gray" in frames.columns else "px"
    kernels.small_batches(frames.sparkSession)
    first = first_rows(frames, n).select("source_id", "width", "height", F.col(px).alias("px"))

    def median(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            values, lengths = kernels.flat(batch.column("px"))
            held += [v.copy() for v in np.split(values, np.cumsum(lengths)[:-1])]
            told = batch.select(["source_id", "width", "height"]).slice(0, 1)
        twice = counting_median(np.stack(held)).astype("<u2").tobytes()
        yield pa.RecordBatch.from_arrays([*told.columns, pa.array([twice], pa.binary())], names=[*told.schema.names, "twice"])

    return first.groupBy("source_id").applyInArrow(median, "source_id string, width int, height int, twice binary")


def pixel_median(frames: DataFrame, n: int = FIRST_FRAMES) -> DataFrame:
    """(source_id, width, height, y, x, v): per pixel the median of the first n frames."""
    keys = ["source_id", "width", "height"]

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        twice = [np.frombuffer(t, "<u2") for t in batch.column("twice").to_pylist()]
        again = pa.array(np.repeat(np.arange(len(twice)), [len(t) for t in twice]))
        y, x = (np.concatenate([np.divmod(np.arange(len(t)), w)[k] for t, w in zip(twice, batch.column("width").to_pylist(), strict=True)]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(again) for c in keys), pa.array(y, pa.int32()), pa.array(x, pa.int32()), pa.array(np.concatenate(twice) / 2)], names=[*keys, "y", "x", "v"])

    return kernels.mapped(median_images(frames, n).select(*keys, "twice"), "source_id string, width int, height int, y int, x int, v double", rows)


def profiles(images: DataFrame) -> DataFrame:
    """(source_id, side, i, v): the medians of each row (side y) and column (side x) of median images."""

    def sides(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for source, w, twice in zip(*(batch.column(c).to_pylist() for c in ("source_id", "width", "twice")), strict=True):
            image = np.frombuffer(twice, "<u2").reshape(-1, w)
            out += [(source, side, i, v / 4) for side, rows in (("y", image.T), ("x", image)) for i, v in enumerate(counting_median(rows, 512).tolist())]
        columns = zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int32(), pa.float64()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=["source_id", "side", "i", "v"])

    return kernels.mapped(images.select("source_id", "width", "twice"), "source_id string, side string, i int, v double", sides)


def lit_shares(images: DataFrame) -> DataFrame:
    """(source_id, w, h, lit): the share of pixels of median images that are not black."""

    def share(batch: pa.RecordBatch) -> pa.RecordBatch:
        lit = [float((np.frombuffer(t, "<u2") > 2 * BLACK_LEVEL).mean()) for t in batch.column("twice").to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("source_id", "width", "height")), pa.array(lit)], names=["source_id", "w", "h", "lit"])

    return kernels.mapped(images.select("source_id", "width", "height", "twice"), "source_id string, w int, h int, lit double", share)


def automatic_roi(frames: DataFrame, n: int = FIRST_FRAMES) -> DataFrame:
    """(source_id, x, y, width, height, warning): the frame less its outer black rows and columns.

    Too dark a source, or too small a rest, keeps the full frame and says why.
    """
    images = median_images(frames, n)
    lit = lit_shares(images)
    bright = F.when(F.col("v") > BLACK_LEVEL, F.col("i"))
    ends = profiles(images).groupBy("source_id").agg(*(f(F.when(F.col("side") == side, bright)).alias(f"{name}_{side}") for side in ("x", "y") for f, name in ((F.min, "first"), (F.max, "last"))))
    # A profile that is black throughout counts in full from either end.
    before = lambda side, length: F.coalesce(F.col(f"first_{side}"), length)
    after = lambda side, length: F.coalesce(length - 1 - F.col(f"last_{side}"), length)
    w, h = F.col("w"), F.col("h")
    found = lit.join(ends, "source_id").withColumns({"left": before("x", w), "right": after("x", w), "top": before("y", h), "bottom": after("y", h)})
    rw, rh = w - F.col("left") - F.col("right"), h - F.col("top") - F.col("bottom")
    warning = F.when(F.col("lit") < LEAST_SHARE, "black_intro").when((rw <= 0) | (rh <= 0) | (rw < LEAST_SHARE * w) | (rh < LEAST_SHARE * h), "implausible_roi")
    full = warning.isNotNull()
    pick = lambda a, b: F.when(full, a).otherwise(b).cast("int")
    return found.select("source_id", pick(F.lit(0), F.col("left")).alias("x"), pick(F.lit(0), F.col("top")).alias("y"), pick(w, rw).alias("width"), pick(h, rh).alias("height"), warning.alias("warning"))


def scaled_by_size(rect: Column, sw: Column, sh: Column, dw: Column, dh: Column) -> Column:
    """Cache rectangle to display: floor of the origin, and the width and height scaled up by themselves."""
    x, y = div_floor(rect["x"] * dw, sw), div_floor(rect["y"] * dh, sh)
    w, h = F.greatest(F.lit(1), div_ceil(rect["width"] * dw, sw)), F.greatest(F.lit(1), div_ceil(rect["height"] * dh, sh))
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.least(w, dw - x).cast("int").alias("width"), F.least(h, dh - y).cast("int").alias("height"))


def scaled_by_edge(rect: Column, sw: Column, sh: Column, dw: Column, dh: Column) -> Column:
    """Cache rectangle to display: floor of the origin, ceiling of the far edge."""
    x, y = div_floor(rect["x"] * dw, sw), div_floor(rect["y"] * dh, sh)
    x1, y1 = F.least(dw, div_ceil((rect["x"] + rect["width"]) * dw, sw)), F.least(dh, div_ceil((rect["y"] + rect["height"]) * dh, sh))
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), (x1 - x).cast("int").alias("width"), (y1 - y).cast("int").alias("height"))


def resolve_roi(sources: DataFrame, first_frame: DataFrame, first_frames: DataFrame) -> DataFrame:
    """(source_id, roi, roi_origin, warning) of sources (roi_mode, manual_roi, display and cache sizes).

    Mode full takes the display, manual the given rectangle, auto the proposal of the first frame or, if that came with a
    warning, that of the first frames; proposals are in cache pixels and are scaled to the display.
    """
    prefixed = lambda df, p: df.select("source_id", F.struct("x", "y", "width", "height").alias(f"{p}_rect"), F.col("warning").alias(f"{p}_warning"))
    joined = sources.join(prefixed(first_frame, "one"), "source_id", "left").join(prefixed(first_frames, "many"), "source_id", "left")
    sizes = (F.col("cache_w"), F.col("cache_h"), F.col("display_w"), F.col("display_h"))
    full = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("display_w").cast("int").alias("width"), F.col("display_h").cast("int").alias("height"))
    trusted = F.col("one_rect").isNotNull() & F.col("one_warning").isNull()
    auto = F.when(trusted, scaled_by_edge(F.col("one_rect"), *sizes)).when(F.col("many_rect").isNotNull(), scaled_by_size(F.col("many_rect"), *sizes)).otherwise(full)
    mode = F.col("roi_mode")
    return joined.select(
        "source_id",
        F.when(mode == "full", full).when(mode == "manual", F.col("manual_roi")).otherwise(auto).alias("roi"),
        F.when(mode != "auto", mode).when(trusted, "first_frame").when(F.col("many_rect").isNotNull(), "first_frames").otherwise("full").alias("roi_origin"),
        F.when((mode == "auto") & ~trusted, F.col("many_warning")).alias("warning"),
    )
