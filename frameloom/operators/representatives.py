"""One representative frame a segment, chosen by what its frames have in common.

Tiles meet the numbers of their segments (a small table, which Spark broadcasts if it may) and are then exchanged by
(source, segment, tile). A row of the working table is a chunk of at most CHUNK frames of one tile, so that a segment of any
length is a stream of bounded rows: composites and supports are first reduced inside a chunk, by numpy kernels over Arrow
batches, then over a tile's chunks, and joined back to the chunks along the same partitioning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixels
from ..settings import SpatialSettings
from . import kernels

CHUNK = 256
TILE_KEY = ["source_id", "segment_ix", "ty", "tx"]


def chunked(tiles: DataFrame, numbered: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(source_id, segment_ix, ty, tx, chunk, ok, frames): up to ``chunk`` frames of one tile of one segment."""
    joined = tiles.join(numbered.select("source_id", "ordinal", "segment_ix"), ["source_id", "ordinal"]).repartition(*TILE_KEY)
    part = F.floor(F.col("ordinal") / chunk).cast("int").alias("chunk")
    return joined.groupBy(*TILE_KEY, part).agg(F.first("ok").alias("ok"), F.collect_list(F.struct("ordinal", "px", "edge")).alias("frames"))


def _over(items: Column, combine, first: Column) -> Column:
    """A reduction of a non-empty array that begins with its first item."""
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items), F.lit(1))), first, combine)


_KEYS = "source_id string, segment_ix {ix}, ty int, tx int"


def _keys(chunks: DataFrame) -> str:
    return _KEYS.format(ix=chunks.schema["segment_ix"].dataType.simpleString())


def composites(chunks: DataFrame) -> DataFrame:
    """Per segment and tile the brightest value of each pixel over the segment's frames, masked or not."""

    def brightest(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = kernels.Chunks(batch)
        tops = [own.matrix("px", k).max(axis=0) for k in range(len(own))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in TILE_KEY), kernels.lists(tops, pa.int16()), pa.array(own.counts.astype(np.int32))], names=[*TILE_KEY, "own", "k"])

    per_chunk = kernels.mapped(chunks.select(*TILE_KEY, "frames"), f"{_keys(chunks)}, own array<smallint>, k int", brightest)
    return per_chunk.groupBy(*TILE_KEY).agg(F.collect_list("own").alias("parts"), F.sum("k").cast("long").alias("n_frames")).select(*TILE_KEY, "n_frames", _over(F.col("parts"), pixels.brighter, F.get("parts", F.lit(0))).alias("composite"))


def supports(chunks: DataFrame, brightest: DataFrame, settings: SpatialSettings) -> DataFrame:
    """Per segment and tile: composite, supported (marked in enough frames) and core (an edge in enough frames) pixels."""
    delta = settings.pixel_delta

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = kernels.Chunks(batch)
        marks, edges = [], []
        for k, (top, ok) in enumerate(zip(own.rows("composite"), own.rows("ok"), strict=True)):
            marks.append(((top.astype(np.int32) - own.matrix("px", k)) > delta).sum(axis=0, dtype=np.int32) * ok)
            edges.append(own.matrix("edge", k).sum(axis=0, dtype=np.int32) * ok)
        names = [*TILE_KEY, "composite", "n_frames"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(kernels.lists(x, pa.int32()) for x in (marks, edges))], names=[*names, "marks", "edges"])

    counted = kernels.mapped(chunks.join(brightest, TILE_KEY).select(*TILE_KEY, "composite", "n_frames", "ok", "frames"), f"{_keys(chunks)}, composite array<smallint>, n_frames long, marks array<int>, edges array<int>", count)
    # A row a chunk and tile from here on, no longer a frame.
    summed = counted.groupBy(*TILE_KEY).agg(F.first("composite").alias("composite"), F.first("n_frames").alias("n_frames"), F.collect_list("marks").alias("marks"), F.collect_list("edges").alias("edges"))
    total = lambda name: _over(F.col(name), pixels.plus, F.get(name, F.lit(0)))
    summed = summed.select(*TILE_KEY, "composite", "n_frames", total("marks").alias("mark_counts"), total("edges").alias("edge_counts"))
    enough = F.least(F.lit(settings.support_samples).cast("long"), F.col("n_frames"))
    core = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n_frames").cast("double") * settings.core_edge_fraction))
    return summed.withColumn("supported", F.transform("mark_counts", lambda c: c >= enough)).withColumn("core", F.transform("edge_counts", lambda c: c >= core))


def tile_scores(chunks: DataFrame, supported: DataFrame, settings: SpatialSettings) -> DataFrame:
    """Per frame and tile: retained, transient and missing pixels, and whether the tile may be covered."""
    delta = settings.pixel_delta
    names = ("valid", "marked", "lost", "retained", "transient", "missing")

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = kernels.Chunks(batch)
        found: list[list[np.ndarray]] = [[] for _ in names]
        columns = (own.rows(c) for c in ("composite", "ok", "supported", "core"))
        for k, (top, ok, held, core) in enumerate(zip(*columns, strict=True)):
            marks = ((top.astype(np.int32) - own.matrix("px", k)) > delta) & ok
            kept = marks & held
            marked, retained = marks.sum(axis=1), kept.sum(axis=1)
            lost = (core & ~(own.matrix("edge", k) & ok)).sum(axis=1)
            for into, x in zip(found, (np.full(len(marks), ok.sum()), marked, lost, retained, marked - retained, held.sum() - retained), strict=True):
                into.append(x)
        again = pa.array(np.repeat(np.arange(len(own)), own.counts))
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(again) for c in TILE_KEY), pa.array(own.ordinals), *(pa.array(np.concatenate(x).astype(np.int32)) for x in found)], names=[*TILE_KEY, "ordinal", *names])

    joined = chunks.join(supported.select(*TILE_KEY, "composite", "supported", "core"), TILE_KEY).select(*TILE_KEY, "ok", "frames", "composite", "supported", "core")
    rows = kernels.mapped(joined, f"{_keys(chunks)}, ordinal int, {', '.join(f'{n} int' for n in names)}", score)
    covered = (F.col("valid") > 0) & (F.col("marked") / F.col("valid") >= settings.overlay_fraction) & (F.col("lost") >= settings.overlay_missing_edges)
    return rows.withColumn("covered", covered)


def with_neighbour(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The cells (keys, ty, tx) that have one of their four neighbours among them: an equi-join on shifted places."""
    shifts = F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in ((1, 0), (-1, 0), (0, 1), (0, -1))))
    beside = cells.select(*keys, F.explode(shifts).alias("d"), "ty", "tx").select(*keys, (F.col("ty") + F.col("d.y")).alias("ty"), (F.col("tx") + F.col("d.x")).alias("tx"))
    return cells.join(beside, [*keys, "ty", "tx"], "left_semi")


def frame_scores(scores: DataFrame) -> DataFrame:
    """Per frame: occlusion (covered tiles next to another one), retained, transient and missing pixels."""
    keys = ["source_id", "segment_ix", "ordinal"]
    sums = scores.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("retained", "transient", "missing")))
    occluded = with_neighbour(scores.where("covered").select(*keys, "ty", "tx"), keys).groupBy(*keys).agg(F.count("*").alias("occluded"))
    return sums.join(occluded, keys, "left").withColumn("occluded", F.coalesce("occluded", F.lit(0).cast("long")))


def elect(frames: DataFrame, transient_penalty: float) -> DataFrame:
    """Per segment the frame with the least occlusion, then the best score; the latest wins ties. With its diagnostics."""
    score = F.col("retained") - transient_penalty * F.col("transient")
    key = F.struct((-F.col("occluded")).alias("a"), score.alias("b"), F.col("ordinal").alias("c"))
    told = F.struct("ordinal", "missing", "retained", "occluded")
    return frames.groupBy("source_id", "segment_ix").agg(F.max_by(told, key).alias("t")).select("source_id", "segment_ix", F.col("t.ordinal").alias("rep_ordinal"), F.col("t.missing").alias("missing_supported"), F.col("t.retained").alias("retained_supported"), F.col("t.occluded").alias("occlusion_tiles"))


def representatives(tiles: DataFrame, numbered: DataFrame, settings: SpatialSettings, chunk: int = CHUNK) -> DataFrame:
    chunks = chunked(tiles, numbered, chunk)
    supported = supports(chunks, composites(chunks), settings)
    return elect(frame_scores(tile_scores(chunks, supported, settings)), settings.transient_penalty)
