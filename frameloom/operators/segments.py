"""Boundaries, segments, pages of segments, and navigation ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.rational import seconds
from ..settings import SpatialSettings
from . import scans


def _by(order: str) -> WindowSpec:
    return Window.partitionBy("source_id").orderBy(order)


def segment_numbers(samples: DataFrame, flags: DataFrame, order: str = "ordinal", stretch: int | None = None) -> DataFrame:
    """Samples with is_boundary and segment_ix, the running count of boundaries. Rows here hold no pixels; for ``stretch`` see ``scans``."""
    marked = samples.join(flags.select("source_id", order, "is_boundary"), ["source_id", order], "left").withColumn("is_boundary", F.coalesce("is_boundary", F.lit(False)))
    return scans.running_count(marked, F.col("is_boundary"), order, "segment_ix", stretch).withColumn("segment_ix", F.col("segment_ix").cast("int"))


def spatial_flags(pairs: DataFrame, settings: SpatialSettings) -> DataFrame:
    """Whether a pair of neighbouring frames is a boundary: both shares reach their thresholds."""
    return pairs.withColumn("is_boundary", (F.col("changed_fraction") >= settings.changed_fraction) & (F.col("cell_fraction") >= settings.cell_fraction))


def boundaries(numbered: DataFrame, pairs: DataFrame, stretch: int | None = None) -> DataFrame:
    """(source_id, boundary_ix, left_ordinal, right_ordinal, lower_ticks, upper_ticks, status, persistence, scores)."""
    left = scans.neighbours(numbered, F.struct("ordinal", "ticks"), "ordinal", before="left", stretch=stretch)
    timed = left.withColumn("left_ordinal", F.col("left.ordinal")).withColumn("lower_ticks", F.col("left.ticks")).where("is_boundary")
    scored = timed.join(pairs.select("source_id", "ordinal", "changed_fraction", "cell_fraction"), ["source_id", "ordinal"])
    return scored.select(
        "source_id", (F.col("segment_ix") - 1).alias("boundary_ix"), "left_ordinal", F.col("ordinal").alias("right_ordinal"), "lower_ticks", F.col("ticks").alias("upper_ticks"),
        F.lit("spatial_change").alias("status"), F.lit(1).alias("persistence"), F.struct("changed_fraction", "cell_fraction").alias("scores"),
    )


def segment_bounds(numbered: DataFrame, sources: DataFrame) -> DataFrame:
    """First and last sample, and half-open times: from 0 for the first segment, to the duration for the last."""
    found = numbered.groupBy("source_id", "segment_ix").agg(F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"), F.min("ticks").alias("first_ticks"))
    order = _by("segment_ix")
    timed = found.withColumn("end_ticks", F.lead("first_ticks").over(order)).withColumn("start_ticks", F.when(F.col("segment_ix") == 0, F.lit(0).cast("long")).otherwise(F.col("first_ticks")))
    closed = timed.join(sources.select("source_id", "duration_ticks"), "source_id")
    return closed.select("source_id", "segment_ix", "first_ordinal", "last_ordinal", "start_ticks", F.coalesce("end_ticks", "duration_ticks").alias("end_ticks"), F.when(F.col("segment_ix") > 0, F.col("segment_ix") - 1).alias("start_boundary_ix"))


def pages_of_segments(segments: DataFrame) -> DataFrame:
    """One automatic page a segment. Identifiers are digests of the place, so runs can be compared."""
    page_id = F.sha2(F.concat_ws("/", F.col("source_id"), F.lit("auto"), F.col("segment_ix").cast("string")), 256).substr(1, 32)
    return segments.select("source_id", page_id.alias("page_id"), "rep_ordinal", F.lit("auto").alias("origin"), F.col("segment_ix").alias("origin_segment_ix"), F.col("segment_ix").alias("derived_segment_ix"), F.lit(None).cast("string").alias("last_edit"))


def ranked(pages: DataFrame, stretch: int | None = None) -> DataFrame:
    """Pages with their number from 1 in time order; ``stretch`` is in ticks."""
    return scans.ranks(pages, "ticks", "page", stretch).withColumn("page", F.col("page").cast("int"))


def navigation(pages: DataFrame, sources: DataFrame, stretch: int | None = None) -> DataFrame:
    """(source_id, page, page_id, start_ticks, end_ticks, start_s, end_s, reject_code) of pages with their times (ticks).

    Page 1 starts at 0; a page ends where the next begins, the last one at the duration; empty ranges are rejected.
    """
    timed = scans.neighbours(ranked(pages, stretch), F.col("ticks"), "ticks", after="next_ticks", stretch=stretch).join(sources.select("source_id", "duration_ticks", "tb_num", "tb_den"), "source_id")
    start = F.when(F.col("page") == 1, F.lit(0).cast("long")).otherwise(F.col("ticks"))
    timed = timed.withColumn("start_ticks", start).withColumn("end_ticks", F.coalesce("next_ticks", "duration_ticks"))
    num, den = F.col("tb_num"), F.col("tb_den")
    return timed.select("source_id", "page", "page_id", "start_ticks", "end_ticks", seconds(F.col("start_ticks"), num, den).alias("start_s"), seconds(F.col("end_ticks"), num, den).alias("end_s"), F.when((F.col("end_ticks") <= F.col("start_ticks")) | (F.col("start_ticks") < 0), F.lit("InvalidNavigation")).alias("reject_code"))
