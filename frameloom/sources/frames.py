"""Frame tables: integrity of what is read, and preparation of colour frames for the detectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FRAME_SCHEMA = "source_id string, ordinal int, pts long, width int, height int, gray binary"


def read_frames(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return check_frames(spark.read.schema(FRAME_SCHEMA).parquet(path))


def check_frames(frames: DataFrame, payload: str = "gray", channels: int = 1, stride: int = 1) -> tuple[DataFrame, DataFrame]:
    """(frames, rejects) of sources as a whole: (source_id, reject_code).

    Each payload has width x height x channels bytes, ordinals are the places in order times the stride, times rise
    strictly, and a source has one size.
    """
    order = Window.partitionBy("source_id").orderBy("pts", "ordinal")
    light = frames.select("source_id", "ordinal", "pts", "width", "height", F.octet_length(payload).alias("n"))
    rows = light.withColumn("place", F.row_number().over(order) - 1).withColumn("before", F.lag("pts").over(order))
    by = rows.groupBy("source_id").agg(
        F.bool_or(F.coalesce(F.col("n") != F.col("width") * F.col("height") * channels, F.lit(True))).alias("payload"),
        F.bool_or((F.col("ordinal") != F.col("place") * stride) | F.coalesce(F.col("pts") <= F.col("before"), F.lit(False))).alias("timing"),
        F.count_distinct("width", "height").alias("sizes"),
    )
    bad = by.select("source_id", F.when(F.col("payload"), "DecodeFailed").when(F.col("timing"), "InvalidTiming").when(F.col("sizes") > 1, "SourceChanged").alias("reject_code")).where("reject_code IS NOT NULL")
    return frames.join(bad, "source_id", "left_anti"), bad


def area_mean(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Exact area averages: a pixel of the result is the mean of what it covers, parts of pixels by their share."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.arange(m + 1) * n / m
        at = np.arange(n)
        return np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None) * m / n

    return weights(gray.shape[0], height) @ gray @ weights(gray.shape[1], width).T


def prepare_frames(frames: DataFrame) -> DataFrame:
    """Colour frames (rgb binary, cached struct, detector_w, detector_h) cropped, turned gray and averaged to detector size.

    Gray is 0.299 r + 0.587 g + 0.114 b; both steps round half to even. Gives the schema of frame tables.
    """
    parts = [F.col(f"cached.{c}").cast("int").alias(f"c_{c}") for c in ("x", "y", "width", "height")]
    rows = frames.select("source_id", "ordinal", "pts", "width", "height", "rgb", *parts, F.col("detector_w").cast("int").alias("dw"), F.col("detector_h").cast("int").alias("dh"))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                rgb = np.frombuffer(r["rgb"], np.uint8).reshape(r["height"], r["width"], 3)
                cut = rgb[r["c_y"] : r["c_y"] + r["c_height"], r["c_x"] : r["c_x"] + r["c_width"]].astype(np.float64)
                gray = np.rint(cut @ np.array([0.299, 0.587, 0.114]))
                small = np.rint(np.round(area_mean(gray, r["dh"], r["dw"]), 9)).astype(np.uint8)
                out.append((r["source_id"], r["ordinal"], r["pts"], r["dw"], r["dh"], small.tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["source_id", "ordinal", "pts", "width", "height", "gray"])

    return rows.mapInArrow(prepare, FRAME_SCHEMA)
