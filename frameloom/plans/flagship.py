"""From frames to navigation ranges: the plan behind the flagship query, and its parts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changes, representatives, segments, strips, tiles
from ..settings import SpatialSettings
from .staging import staged


@dataclass(frozen=True)
class Analysis:
    """Parts of an analysis. They are lazy, but for binary frames: their strips and segment numbers are staged as the plan is made."""

    tiles: DataFrame
    pairs: DataFrame
    numbered: DataFrame
    boundaries: DataFrame
    bounds: DataFrame
    chunks: DataFrame
    reps: DataFrame
    segments: DataFrame
    pages: DataFrame
    navigation: DataFrame


def analyse(frames: DataFrame, sources: DataFrame, samples: DataFrame, settings: SpatialSettings, chunk: int = strips.CHUNK, stretch: int | None = None, ticks_stretch: int | None = None) -> Analysis:
    """frames (source_id, ordinal, width, height, px or gray[, excluded]), sources (…, duration_ticks, tb_num, tb_den), samples (source_id, ordinal, ticks).

    px is an array, gray a binary value a frame: the form for frames of real size, whose pixels are exchanged once, as strips.
    ``stretch`` (ordinals) and ``ticks_stretch`` cut the line of long sources, so that no task orders a whole one.
    """
    sizes = (settings.tile, settings.edge_delta)
    if "gray" in frames.columns:
        cut = tiles.split_tiles_binary(frames, *sizes, packed=True)
        own = strips.cut_strips(frames, *sizes, chunk)
        pairs = changes.pair_changes(strips.strip_changes(own, settings.pixel_delta), settings.cell_changed_fraction)
    else:
        cut = tiles.split_tiles(frames, *sizes)
        pairs = changes.spatial_changes(cut, settings)
    numbered = segments.segment_numbers(samples, segments.spatial_flags(pairs, settings), stretch=stretch)
    if "gray" in frames.columns:
        numbered = staged(numbered)  # a few numbers a frame, which several steps read
        scores = strips.strip_scores(strips.with_segments(own, numbered, chunk), settings)
        reps = representatives.elect(representatives.frame_scores(scores), settings.transient_penalty)
    else:
        reps = representatives.representatives(cut, numbered, settings)
    bounds = segments.segment_bounds(numbered, sources)
    closed = bounds.join(reps.select("source_id", "segment_ix", "rep_ordinal"), ["source_id", "segment_ix"])
    pages = segments.pages_of_segments(closed)
    timed = pages.join(samples.select("source_id", F.col("ordinal").alias("rep_ordinal"), "ticks"), ["source_id", "rep_ordinal"])
    return Analysis(cut, pairs, numbered, segments.boundaries(numbered, pairs, stretch), bounds, representatives.chunked(cut, numbered), reps, closed, timed, segments.navigation(timed, sources, ticks_stretch))
