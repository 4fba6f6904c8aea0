"""Registered queries over frames: tiles, changes, segments, representatives, pages and navigation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import changes, representatives, segments, tiles
from . import flagship


def analysis(spark: SparkSession, sf_dir: str) -> flagship.Analysis:
    frames = fx.frames(spark, sf_dir)
    sources = fx.frame_sources(frames)
    return flagship.analyse(frames, sources, fx.timed_samples(frames, sources), fx.SMALL)


def packed_analysis(spark: SparkSession, sf_dir: str) -> flagship.Analysis:
    """The same over frames of one binary value each: the form for frames of real size. Chunks of 16 frames, so segments span them."""
    frames = fx.frames(spark, sf_dir)
    gray = F.unhex(F.array_join(F.transform("px", lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), "")).alias("gray")
    sources = fx.frame_sources(frames)
    return flagship.analyse(frames.select("source_id", "ordinal", "width", "height", gray), sources, fx.timed_samples(frames, sources), fx.SMALL, chunk=16)


def _text(column) -> object:
    return F.array_join(F.transform(column, lambda v: v.cast("string")), " ")


def p10_split_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = tiles.split_tiles(fx.frames(spark, sf_dir), fx.SMALL.tile, fx.SMALL.edge_delta)
    return cut.select("source_id", "ordinal", "ty", "tx", _text("px").alias("px"), F.size(F.filter("edge", lambda x: x)).cast("long").alias("n_edges"))


def p07_valid_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three sources have a mask: pixels in sight by tile of the masked frames."""
    excluded = F.when(F.col("source_id").cast("int") % 3 != 0, F.struct(F.lit(1).alias("x"), F.lit(3).alias("y"), (F.col("source_id").cast("int") % 3 + 2).alias("width"), F.lit(2).alias("height")))
    masked = fx.frames(spark, sf_dir).withColumn("excluded", excluded)
    cut = tiles.split_tiles(masked, 3, fx.SMALL.edge_delta)
    return cut.select("source_id", "ordinal", "ty", "tx", F.size("ok").cast("long").alias("pixels"), F.size(F.filter("ok", lambda x: x)).cast("long").alias("valid"))


def j06_adjacent_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = changes.adjacent_tiles(analysis(spark, sf_dir).tiles)
    return pairs.select("source_id", "ordinal", "prev_ordinal", "ty", "tx", _text("px").alias("px"), _text("prev_px").alias("prev_px"))


def a02_tile_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.tile_changes(analysis(spark, sf_dir).tiles, fx.SMALL.pixel_delta).select("source_id", "ordinal", "ty", "tx", "valid", "changed")


def a03_pair_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).pairs.drop("prev_ordinal")


def w03_segment_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).numbered.select("source_id", "ordinal", "is_boundary", "segment_ix")


def w03_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).boundaries.select("source_id", "boundary_ix", "left_ordinal", "right_ordinal", "lower_ticks", "upper_ticks", "status", "persistence", F.col("scores.changed_fraction").alias("changed_fraction"), F.col("scores.cell_fraction").alias("cell_fraction"))


def w04_segment_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).bounds


def a08_bright_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return representatives.composites(analysis(spark, sf_dir).chunks).select("source_id", "segment_ix", "ty", "tx", "n_frames", _text("composite").alias("composite"))


def a09_support_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = analysis(spark, sf_dir).chunks
    found = representatives.supports(chunks, representatives.composites(chunks), fx.SMALL)
    number = lambda c: F.size(F.filter(c, lambda x: x)).cast("long")
    return found.select("source_id", "segment_ix", "ty", "tx", number("supported").alias("supported"), number("core").alias("core"))


def a10_frame_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = analysis(spark, sf_dir).chunks
    supported = representatives.supports(chunks, representatives.composites(chunks), fx.SMALL)
    return representatives.frame_scores(representatives.tile_scores(chunks, supported, fx.SMALL))


def a11_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).reps.select("source_id", "segment_ix", "rep_ordinal")


def a12_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).reps


def j11_tile_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the tiles with a change between two frames, those beside another one."""
    moved = changes.tile_changes(analysis(spark, sf_dir).tiles, fx.SMALL.pixel_delta).where("changed >= 2")
    return representatives.with_neighbour(moved.select("source_id", "ordinal", "ty", "tx"), ["source_id", "ordinal"])


def e07_pages_of_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).pages.select("source_id", "page_id", "rep_ordinal", "origin", "origin_segment_ix", "ticks")


def w05_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: frames to tiles, changes, segments, representatives, pages and navigation ranges."""
    return analysis(spark, sf_dir).navigation


def w09_page_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.ranked(analysis(spark, sf_dir).pages).select("source_id", "page_id", "page")


def a03_packed_pair_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_analysis(spark, sf_dir).pairs.drop("prev_ordinal")


def a12_packed_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_analysis(spark, sf_dir).reps


def w05_packed_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship over binary frames, whose pixels are exchanged once."""
    return packed_analysis(spark, sf_dir).navigation


QUERIES = {f.__name__: f for f in (p07_valid_pixels, p10_split_tiles, j06_adjacent_pair, a02_tile_change, a03_pair_change, w03_segment_numbers, w03_boundaries, w04_segment_bounds, a08_bright_composite, a09_support_counts, a10_frame_score, a11_representative, a12_diagnostics, j11_tile_neighbours, e07_pages_of_segments, w05_navigation, w09_page_rank, a03_packed_pair_change, a12_packed_diagnostics, w05_packed_navigation)}

_F, _S, _R = fx.FRAMES_SQL, fx.SEGMENTS_SQL, fx.REPRESENTATIVES_SQL
SQL = {
    "p10_split_tiles": fx.sql("SELECT source_id, ordinal, y // 2 AS ty, x // 2 AS tx, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY y, x) AS px, count(*) FILTER (edge) AS n_edges FROM e GROUP BY ALL", _F, _S),
    "p07_valid_pixels": fx.sql(
        """SELECT source_id, ordinal, y // 3 AS ty, x // 3 AS tx, count(*) AS pixels,
        count(*) FILTER (NOT (CAST(source_id AS INT) % 3 <> 0 AND x >= 1 AND x < 3 + CAST(source_id AS INT) % 3 AND y IN (3, 4))) AS valid FROM p GROUP BY ALL""",
        _F,
    ),
    "j06_adjacent_pair": fx.sql(
        """SELECT p.source_id, p.ordinal, q.ordinal AS prev_ordinal, p.y // 2 AS ty, p.x // 2 AS tx, string_agg(CAST(p.v AS VARCHAR), ' ' ORDER BY p.y, p.x) AS px, string_agg(CAST(q.v AS VARCHAR), ' ' ORDER BY p.y, p.x) AS prev_px
        FROM p JOIN p q ON p.source_id = q.source_id AND p.ordinal = q.ordinal + 1 AND p.y = q.y AND p.x = q.x GROUP BY ALL""",
        _F,
    ),
    "a02_tile_change": fx.sql("SELECT * FROM c", _F, _S),
    "a03_pair_change": fx.sql("SELECT * FROM m", _F, _S),
    "w03_segment_numbers": fx.sql("SELECT source_id, ordinal, is_boundary, segment_ix FROM n", _F, _S),
    "w03_boundaries": fx.sql(
        """SELECT n.source_id, n.segment_ix - 1 AS boundary_ix, l.ordinal AS left_ordinal, n.ordinal AS right_ordinal, l.ticks AS lower_ticks, n.ticks AS upper_ticks, 'spatial_change' AS status, 1 AS persistence, changed_fraction, cell_fraction
        FROM n JOIN m USING (source_id, ordinal) JOIN s l ON l.source_id = n.source_id AND l.ordinal = n.ordinal - 1 WHERE is_boundary""",
        _F, _S,
    ),
    "w04_segment_bounds": fx.sql("SELECT * FROM b", _F, _S),
    "a08_bright_composite": fx.sql("SELECT source_id, segment_ix, y // 2 AS ty, x // 2 AS tx, any_value(n_frames) AS n_frames, string_agg(CAST(top AS VARCHAR), ' ' ORDER BY y, x) AS composite FROM z GROUP BY ALL", _F, _S, _R),
    "a09_support_counts": fx.sql("SELECT source_id, segment_ix, y // 2 AS ty, x // 2 AS tx, count(*) FILTER (supported) AS supported, count(*) FILTER (core) AS core FROM u GROUP BY ALL", _F, _S, _R),
    "a10_frame_score": fx.sql("SELECT * FROM a", _F, _S, _R),
    "a11_representative": fx.sql("SELECT source_id, segment_ix, rep_ordinal FROM r", _F, _S, _R),
    "a12_diagnostics": fx.sql("SELECT * FROM r", _F, _S, _R),
    "j11_tile_neighbours": fx.sql("SELECT source_id, ordinal, ty, tx FROM c WHERE changed >= 2 AND EXISTS (SELECT 1 FROM c t WHERE t.changed >= 2 AND t.source_id = c.source_id AND t.ordinal = c.ordinal AND abs(t.ty - c.ty) + abs(t.tx - c.tx) = 1)", _F, _S),
    "e07_pages_of_segments": fx.sql("SELECT source_id, page_id, rep_ordinal, 'auto' AS origin, segment_ix AS origin_segment_ix, ticks FROM g", _F, _S, _R),
    "w05_navigation": fx.sql(
        """SELECT source_id, page, page_id, start_ticks, end_ticks, start_ticks / 1000 AS start_s, end_ticks / 1000 AS end_s, CASE WHEN end_ticks <= start_ticks THEN 'InvalidNavigation' END AS reject_code FROM (
        SELECT g.source_id, page_id, CAST(row_number() OVER w1 AS INT) AS page, CASE WHEN row_number() OVER w1 = 1 THEN 0 ELSE ticks END AS start_ticks, coalesce(lead(ticks) OVER w1, duration_ticks) AS end_ticks
        FROM g JOIN d USING (source_id) WINDOW w1 AS (PARTITION BY g.source_id ORDER BY ticks))""",
        _F, _S, _R,
    ),
    "w09_page_rank": fx.sql("SELECT source_id, page_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY ticks) AS INT) AS page FROM g", _F, _S, _R),
}
SQL |= {"a03_packed_pair_change": SQL["a03_pair_change"], "a12_packed_diagnostics": SQL["a12_diagnostics"], "w05_packed_navigation": SQL["w05_navigation"]}
