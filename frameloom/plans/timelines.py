"""Assembly of detailed timeline documents from the tables of a run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import seq_id
from ..operators import segments as segment_ops
from ..operators.settings_keys import timeline_version
from ..settings import AnchorSettings, SpatialSettings
from ..sources.timelines import ANCHOR_ALGORITHM, SPATIAL_ALGORITHM, ordered

MASKS = "ARRAY<STRUCT<x:BIGINT,y:BIGINT,width:BIGINT,height:BIGINT>>"


@dataclass(frozen=True)
class Findings:
    """What a document tells of a run: the parts of a spatial analysis, or of the anchor detector's groups."""

    boundaries: DataFrame
    segments: DataFrame
    pages: DataFrame
    navigation: DataFrame


def anchor_findings(groups: DataFrame, samples: DataFrame, sources: DataFrame) -> Findings:
    """Boundaries, segments, pages and ranges of scored groups of the anchor detector."""
    order = Window.partitionBy("source_id").orderBy("group_ix")
    rows = groups.withColumn("left_ordinal", F.lag("last_ordinal").over(order)).withColumn("next_ticks", F.lead("start_ticks").over(order)).join(sources.select("source_id", "duration_ticks"), "source_id")
    timed = samples.select("source_id", F.col("ordinal").alias("left_ordinal"), F.col("ticks").alias("lower_ticks"))
    boundaries = rows.where("group_ix > 0").join(timed, ["source_id", "left_ordinal"]).select(
        "source_id", (F.col("group_ix") - 1).alias("boundary_ix"), "left_ordinal", F.col("first_ordinal").alias("right_ordinal"), "lower_ticks", F.col("start_ticks").alias("upper_ticks"), "status", "persistence", "adjacent", "anchor"
    )
    segments = rows.select(
        "source_id", F.col("group_ix").alias("segment_ix"), "first_ordinal", "last_ordinal", "rep_ordinal", "start_ticks", F.coalesce("next_ticks", "duration_ticks").alias("end_ticks"), F.when(F.col("group_ix") > 0, F.col("group_ix") - 1).alias("start_boundary_ix")
    )
    pages = segment_ops.pages_of_segments(segments).join(samples.select("source_id", F.col("ordinal").alias("rep_ordinal"), "ticks"), ["source_id", "rep_ordinal"])
    return Findings(boundaries, segments, pages, segment_ops.navigation(pages, sources))


def _literals(**values) -> Column:
    return F.struct(*(F.lit(v).alias(n) for n, v in values.items()))


def _detector(settings: SpatialSettings | AnchorSettings, policy: Column) -> Column:
    if isinstance(settings, AnchorSettings):
        s = settings
        return _literals(
            algorithm=ANCHOR_ALGORITHM, image_max_width=320, debounce_samples=s.debounce_samples, global_mad=s.mad, tile_mad=s.tile_mad, pixel_delta=s.pixel_delta, changed_fraction=s.changed_fraction,
            tile_size=s.tile, tile_stride=s.stride, min_tile_valid_fraction=0.5, mask_dilation_px=1, keep_unconfirmed=s.keep_unconfirmed,
        )
    spatial = _literals(pixel_delta=settings.pixel_delta, changed_fraction=settings.changed_fraction, cell_fraction=settings.cell_fraction, cell_changed_fraction=settings.cell_changed_fraction, tile_size=settings.tile)
    chosen = _literals(**{n: getattr(settings, n) for n in ("support_samples", "edge_delta", "core_edge_fraction", "overlay_fraction", "overlay_missing_edges", "transient_penalty")})
    return F.struct(F.lit(SPATIAL_ALGORITHM).alias("algorithm"), F.lit(320).alias("image_max_width"), F.lit(1).alias("mask_dilation_px"), policy.alias("input_policy"), spatial.alias("spatial"), chosen.alias("representative"))


def detailed_documents(run: Findings | Analysis, samples: DataFrame, sources: DataFrame, described: DataFrame, settings: SpatialSettings | AnchorSettings) -> DataFrame:
    """(source_id, document) of a run of the detector that ``settings`` belong to.

    ``described`` has source_id, cache_w, cache_h and the structs source, roi and artifact of a document; it may have mask (a
    rectangle or null), policy (all or half; else all) and index_complete (whether ``samples`` holds the skipped ones too;
    else false). A document's version follows from policy, completeness and detector.
    """
    is_anchor = isinstance(settings, AnchorSettings)
    had = described.columns
    described = described.select(
        *(c for c in had if c not in ("mask", "policy", "index_complete")), (F.when(F.col("mask").isNull(), F.expr("array()")).otherwise(F.array("mask")) if "mask" in had else F.expr("array()")).cast(MASKS).alias("ignore_masks"),
        (F.col("policy") if "policy" in had else F.lit("all")).alias("policy"), (F.col("index_complete") if "index_complete" in had else F.lit(False)).alias("index_complete"),
    )
    timed = samples.join(sources.select("source_id", "tb_num", "tb_den"), "source_id").withColumn("s", (F.col("ticks") * F.col("tb_num")).cast("double") / F.col("tb_den"))
    s_id, b_id, g_id = (lambda p: lambda c: seq_id(p, F.col(c)))("s"), (lambda p: lambda c: seq_id(p, F.col(c)))("b"), (lambda p: lambda c: seq_id(p, F.col(c)))("g")
    maybe = lambda f, c: F.when(F.col(c).isNotNull(), f(c))
    long = lambda c: F.col(c).cast("long")
    sized = timed.join(described.select("source_id", "cache_w", "cache_h", "policy", "index_complete"), "source_id")
    observed = ~F.col("index_complete") | (F.col("policy") == "all") | (F.col("ordinal") % 2 == 0)
    rows = ordered(sized, "ordinal", "samples", sample_id=s_id("ordinal"), ordinal=long("ordinal"), source_pts=long("pts"), timestamp_s=F.col("s"), cache_width=long("cache_w"), cache_height=long("cache_h"), is_analysis_observation=observed)
    clock = sources.select("source_id", "tb_num", "tb_den", "duration_ticks")
    sec = lambda c: (F.col(c) * F.col("tb_num")).cast("double") / F.col("tb_den")
    if is_anchor:
        scores = {"adjacent_metrics": F.col("adjacent"), "anchor_metrics": F.col("anchor")}
    else:
        scores = {"spatial_metrics": F.struct(F.col("scores.changed_fraction").alias("changed_fraction"), F.col("scores.cell_fraction").alias("changed_cell_fraction"))}
    bounds = ordered(
        run.boundaries.join(clock, "source_id"), "boundary_ix", "detected_boundaries", boundary_id=b_id("boundary_ix"), left_sample_id=s_id("left_ordinal"), right_sample_id=s_id("right_ordinal"), lower_s=sec("lower_ticks"), upper_s=sec("upper_ticks"),
        observed_at_s=sec("upper_ticks"), true_boundary_s=F.lit(None).cast("double"), uncertainty_kind=F.lit("keyframe_and_detector"), status=F.col("status"), persistence_samples=long("persistence"),
        **scores,
    )
    segs = ordered(
        run.segments.join(clock, "source_id"), "segment_ix", "detected_segments", segment_id=g_id("segment_ix"), start_s=sec("start_ticks"), end_s=sec("end_ticks"), first_sample_id=s_id("first_ordinal"), last_sample_id=s_id("last_ordinal"),
        auto_representative_sample_id=s_id("rep_ordinal"), start_boundary_id=maybe(b_id, "start_boundary_ix"),
    )
    ranked = run.navigation.select("source_id", "page_id", "page", "start_s", "end_s").join(run.pages, ["source_id", "page_id"]).join(clock, "source_id")
    edit = F.when(F.col("last_edit") == "add", "insert").otherwise(F.coalesce("last_edit", F.col("origin")))
    page_uuid = F.concat_ws("-", *(F.substring("page_id", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    pages = ordered(
        ranked, "page", "pages", page_id=page_uuid, pdf_page=long("page"), representative_sample_id=s_id("rep_ordinal"), representative_timestamp_s=sec("ticks"), origin=F.col("origin"), origin_segment_id=maybe(g_id, "origin_segment_ix"),
        derived_segment_id=maybe(g_id, "derived_segment_ix"), last_edit=edit,
    )
    nav = ordered(ranked, "page", "navigation_ranges", page_id=page_uuid, start_s=F.col("start_s"), end_s=F.col("end_s"), basis=F.lit("representative_order"), is_slide_boundary=F.lit(False))
    parts = described.join(clock, "source_id")
    for table in (rows, bounds, segs, pages, nav):
        parts = parts.join(table, "source_id", "left")
    none = lambda c: F.coalesce(c, F.expr("array()"))
    artifact = F.struct("artifact.export_id", "artifact.project_revision", "artifact.created_at", "artifact.generator_version", "artifact.pdf_basename", F.size(none("pages")).cast("long").alias("pdf_page_count"), "artifact.pdf_sha256")

    def document(version: int) -> Column:
        sampling = [F.lit("decoder-keyframes-v1").alias("algorithm"), F.lit(640).alias("cache_max_width"), F.lit(90).alias("jpeg_quality")]
        sampling += [F.col("policy").alias("selection_policy")] * (version >= 6) + [F.col("index_complete").alias("keyframe_index_complete")] * (version >= 7)
        told = F.col("samples") if version >= 7 else F.transform("samples", lambda x: x.dropFields("is_analysis_observation"))
        whole = F.struct(
            F.lit(version).cast("long").alias("schema_version"), "source", (F.col("duration_ticks") * F.col("tb_num") / F.col("tb_den")).cast("double").alias("duration_s"), F.lit("video_metadata").alias("duration_kind"),
            F.struct(*sampling).alias("sampling"), "roi", "ignore_masks", _detector(settings, F.col("policy") if version >= 7 else F.lit("all")).alias("detector"),
            told.alias("samples"), none("detected_boundaries").alias("detected_boundaries"), "detected_segments", "pages", "navigation_ranges", artifact.alias("artifact"),
        )
        return F.to_json(whole, {"ignoreNullFields": "false"})

    version = timeline_version(F.col("policy"), F.col("index_complete"), F.lit("anchor" if is_anchor else "spatial"))
    text = F.when(version == 7, document(7)).when(version == 6, document(6))
    return parts.select("source_id", (text.otherwise(document(4)) if is_anchor else text).alias("document"))
