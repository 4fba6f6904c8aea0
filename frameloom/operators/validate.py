"""Rules of a parsed timeline document ``d``, each a boolean column that is true where the rule is broken.

A document is one row, so a rule is a test over its own arrays; nothing is exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import detection_geometry
from ..sources.timelines import ANCHOR_ALGORITHM, SPATIAL_ALGORITHM

HASH = "^[0-9a-f]{64}$"
UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
RFC3339 = r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-](([01]\d)|(2[0-3])):[0-5]\d)$"


def _d(name: str) -> Column:
    return F.col(f"d.{name}")


def _broken(array: Column, test) -> Column:
    """Whether some item (with its place) fails a test; an unknown answer counts as failed."""
    return F.exists(F.transform(array, lambda x, i: ~F.coalesce(test(x, i), F.lit(False))), lambda b: b)


def _at(array: Column, i: Column) -> Column:
    return F.get(array, i.cast("int"))


def _id(prefix: str, i: Column) -> Column:
    return F.format_string(f"{prefix}%06d", i.cast("long"))


def _rounded(num: Column, den: Column) -> Column:
    from ..functions.rational import div_half_even

    return div_half_even(num, den)


def _inside(r: Column) -> Column:
    return (F.least(r["width"], r["height"]) >= 1) & (F.least(r["x"], r["y"]) >= 0) & (r["x"] + r["width"] <= _d("source.display_width")) & (r["y"] + r["height"] <= _d("source.display_height"))


def _cache() -> tuple[Column, Column]:
    width = F.least(F.lit(640), _d("source.display_width"))
    return width, F.greatest(F.lit(1), F.bround(_d("source.display_height") * width / _d("source.display_width")).cast("long"))


def _spatial() -> Column:
    return _d("detector.algorithm") == SPATIAL_ALGORITHM


def _detector() -> Column:
    """The fixed policy of a version's detector, and the ranges of its thresholds."""
    detector, spatial, rep, version = _d("detector"), _d("detector.spatial"), _d("detector.representative"), _d("schema_version")
    wide = (detector["image_max_width"] == 320) & (detector["mask_dilation_px"] == 1)
    groups = version.isin(5, 6, 7) & (detector["input_policy"] == F.when(version == 7, _d("sampling.selection_policy")).otherwise("all"))
    for delta in (spatial["pixel_delta"], rep["edge_delta"]):
        groups = groups & delta.between(0, 255)
    for count in (spatial["tile_size"], rep["support_samples"], rep["overlay_missing_edges"]):
        groups = groups & (count >= 1)
    for part in (*(spatial[c] for c in ("changed_fraction", "cell_fraction", "cell_changed_fraction")), *(rep[c] for c in ("core_edge_fraction", "overlay_fraction", "transient_penalty"))):
        groups = groups & (part > 0) & (part <= 1)
    anchor = version.isin(4, 6, 7) & (detector["algorithm"] == ANCHOR_ALGORITHM) & (detector["debounce_samples"] == 2) & (detector["min_tile_valid_fraction"] == 0.5) & detector["pixel_delta"].between(0, 255) & (F.least(detector["tile_size"], detector["tile_stride"]) >= 1)
    for part in ("global_mad", "tile_mad", "changed_fraction"):
        anchor = anchor & detector[part].between(0, 1)
    return wide & F.when(_spatial(), groups).otherwise(anchor)


def _step() -> Column:
    """Every how many samples one is observed: 2 under policy half where the index is complete, else 1."""
    return F.when((_d("schema_version") == 7) & (_d("sampling.selection_policy") == "half") & _d("sampling.keyframe_index_complete"), 2).otherwise(1).cast("long")


def _sampling() -> Column:
    """The fixed sampling, a policy that the version and detector allow, and the samples that it observes."""
    sampling, version = _d("sampling"), _d("schema_version")
    fixed = (sampling["algorithm"] == "decoder-keyframes-v1") & (sampling["cache_max_width"] == 640) & (sampling["jpeg_quality"] == 90) & (F.size(_d("samples")) > 0)
    policy = F.when(version < 6, sampling["selection_policy"].isNull()).when((version == 6) & _spatial(), sampling["selection_policy"] == "all").otherwise(sampling["selection_policy"].isin("all", "half"))
    step = _step()
    observed = F.when(version < 7, True).otherwise(~_broken(_d("samples"), lambda x, i: x["is_analysis_observation"] == (i % step == 0)))
    return fixed & policy & observed


def rules(detectable: Column) -> dict[str, Column]:
    """``detectable``: whether region and mask leave the detector enough pixels.

    Boundaries and segments are held against the samples that the sampling policy observes; V5 tells if others are marked.
    """
    step, spatial_kind = _step(), _spatial()
    s, samples, bounds, segs, pages, nav, art = (_d(x) for x in ("source", "samples", "detected_boundaries", "detected_segments", "pages", "navigation_ranges", "artifact"))
    roi, masks = _d("roi"), _d("ignore_masks")
    base = lambda c: (F.length(c) > 0) & ~c.rlike(r"[/\\]")
    positive = F.least(*(s[c] for c in ("size_bytes", "coded_width", "coded_height", "sar_num", "sar_den", "display_width", "display_height", "time_base_num", "time_base_den"))) > 0
    square = _rounded(s["coded_width"] * s["sar_num"], F.greatest(s["sar_den"], F.lit(1)))
    turned = s["rotation_cw"].isin(90, 270)
    shown = (s["display_width"] == F.when(turned, s["coded_height"]).otherwise(square)) & (s["display_height"] == F.when(turned, square).otherwise(s["coded_height"]))
    source = base(s["basename"]) & base(s["codec"]) & s["chunk_sha256"].rlike(HASH) & positive & (s["stream_index"] >= 0) & s["rotation_cw"].isin(0, 90, 180, 270) & (s["time_origin"] == "first_display_frame") & shown & (_d("duration_s") > 0) & _d("duration_kind").isin("video_metadata", "container_estimate")
    region = _inside(roi) & (F.size(masks) <= 1) & ~_broken(masks, lambda r, i: _inside(r)) & detectable
    seconds = lambda x: ((x["source_pts"] - s["origin_pts"]) * s["time_base_num"]).cast("double") / s["time_base_den"]
    cache_w, cache_h = _cache()
    sample = lambda x, i: (x["sample_id"] == _id("s", i)) & (x["ordinal"] == i) & (x["source_pts"] >= s["origin_pts"]) & (x["timestamp_s"] == seconds(x)) & (x["timestamp_s"] < _d("duration_s")) & ((i == 0) | (x["source_pts"] > _at(samples, i - 1)["source_pts"])) & (x["cache_width"] == cache_w) & (x["cache_height"] == cache_h)
    by_id = lambda x: F.when(x.rlike("^s[0-9]{6,}$"), _at(samples, F.substring(x, 2, 19).try_cast("long")))
    spatial = _d("detector.spatial")
    last_observed = F.floor((F.size(samples) - 1) / step).cast("long") * step
    shares = lambda m: F.least(*(m[c] for c in ("global_mad", "max_tile_mad", "changed_fraction"))).between(0, 1) & (F.greatest(*(m[c] for c in ("global_mad", "max_tile_mad", "changed_fraction"))) <= 1)
    evidence = lambda b: F.when(
        spatial_kind,
        (b["status"] == "spatial_change") & (b["persistence_samples"] == 1) & b["spatial_metrics"]["changed_fraction"].between(spatial["changed_fraction"], 1) & b["spatial_metrics"]["changed_cell_fraction"].between(spatial["cell_fraction"], 1),
    ).otherwise(
        shares(b["adjacent_metrics"]) & shares(b["anchor_metrics"])
        & (((b["status"] == "confirmed") & (b["persistence_samples"] == 2)) | ((b["status"] == "eof_unconfirmed") & (b["persistence_samples"] == 1) & (by_id(b["right_sample_id"])["ordinal"] == last_observed) & _d("detector.keep_unconfirmed")))
    )
    boundary = lambda b, i: (
        (b["boundary_id"] == _id("b", i)) & (by_id(b["left_sample_id"])["ordinal"] % step == 0) & (by_id(b["right_sample_id"])["ordinal"] == by_id(b["left_sample_id"])["ordinal"] + step)
        & ((i == 0) | (by_id(b["right_sample_id"])["ordinal"] > by_id(_at(bounds, i - 1)["right_sample_id"])["ordinal"]))
        & (b["lower_s"] == by_id(b["left_sample_id"])["timestamp_s"]) & (b["upper_s"] == by_id(b["right_sample_id"])["timestamp_s"]) & (b["observed_at_s"] == b["upper_s"])
        & b["true_boundary_s"].isNull() & (b["uncertainty_kind"] == "keyframe_and_detector") & evidence(b)
    )
    first = lambda i: F.when(i == 0, 0).otherwise(by_id(_at(bounds, i - 1)["right_sample_id"])["ordinal"])
    last = lambda i: F.when(i == F.size(bounds), last_observed).otherwise(by_id(_at(bounds, i)["right_sample_id"])["ordinal"] - step)
    segment = lambda g, i: (
        (g["segment_id"] == _id("g", i)) & (g["first_sample_id"] == _id("s", first(i))) & (g["last_sample_id"] == _id("s", last(i)))
        & by_id(g["auto_representative_sample_id"])["ordinal"].between(first(i), last(i)) & (by_id(g["auto_representative_sample_id"])["ordinal"] % step == 0)
        & (g["start_s"] == F.when(i == 0, F.lit(0.0)).otherwise(_at(samples, first(i))["timestamp_s"])) & (g["end_s"] == F.coalesce(_at(samples, last(i) + step)["timestamp_s"], _d("duration_s"))) & (g["start_s"] < g["end_s"])
        & g["start_boundary_id"].eqNullSafe(F.when(i > 0, _at(bounds, i - 1)["boundary_id"]))
    )
    group = lambda x: F.when(x.rlike("^g[0-9]{6,}$"), _at(segs, F.substring(x, 2, 19).try_cast("long")))
    page = lambda p, i: (
        p["page_id"].rlike(UUID) & (p["pdf_page"] == i + 1) & (p["representative_timestamp_s"] == by_id(p["representative_sample_id"])["timestamp_s"])
        & (group(p["derived_segment_id"])["start_s"] <= p["representative_timestamp_s"]) & (p["representative_timestamp_s"] < group(p["derived_segment_id"])["end_s"])
        & ((i == 0) | (by_id(p["representative_sample_id"])["ordinal"] > by_id(_at(pages, i - 1)["representative_sample_id"])["ordinal"]))
        & (((p["origin"] == "auto") & group(p["origin_segment_id"]).isNotNull() & p["last_edit"].isin("auto", "replace")) | ((p["origin"] == "manual") & p["origin_segment_id"].isNull() & p["last_edit"].isin("insert", "replace")))
    )
    unique = F.size(F.array_distinct(F.transform(pages, lambda p: p["page_id"]))) == F.size(pages)
    ranges = lambda n, i: (n["page_id"] == _at(pages, i)["page_id"]) & (n["basis"] == "representative_order") & ~n["is_slide_boundary"] & (n["start_s"] == F.when(i == 0, F.lit(0.0)).otherwise(_at(pages, i)["representative_timestamp_s"])) & (n["end_s"] == F.coalesce(_at(pages, i + 1)["representative_timestamp_s"], _d("duration_s")))
    artifact = art["export_id"].rlike(UUID) & art["created_at"].rlike(RFC3339) & F.try_to_timestamp(F.upper(art["created_at"])).isNotNull() & (art["project_revision"] >= 0) & base(art["generator_version"]) & base(art["pdf_basename"]) & art["pdf_basename"].endswith(".pdf") & (F.length(art["pdf_basename"]) >= 5) & (art["pdf_page_count"] == F.size(pages)) & art["pdf_sha256"].rlike(HASH)
    ok = {
        "V2.source": source,
        "V3.region": region,
        "V4.samples": ~_broken(samples, sample),
        "V5.observation": _sampling() & _detector(),
        "V6.boundaries": ~_broken(bounds, boundary),
        "V7.segments": (F.size(segs) == F.size(bounds) + 1) & ~_broken(segs, segment),
        "V8.pages": (F.size(pages) > 0) & unique & ~_broken(pages, page),
        "V8.navigation": (F.size(nav) == F.size(pages)) & ~_broken(nav, ranges),
        "V8.artifact": artifact,
    }
    return {name: ~F.coalesce(test, F.lit(False)) for name, test in ok.items()}


def violations(documents: DataFrame) -> DataFrame:
    """Adds ``broken``: the names of the rules that a parsed document ``d`` breaks, in order."""
    roi, mask, (cache_w, cache_h) = _d("roi"), F.get(_d("ignore_masks"), F.lit(0)), _cache()
    # The document's own columns are kept aside: the geometry adds many. What is no rectangle of the picture counts as none there.
    rows = documents.select(
        F.struct("*").alias("row"), "d", _d("source.display_width").alias("display_w"), _d("source.display_height").alias("display_h"),
        cache_w.alias("cache_w"), cache_h.alias("cache_h"), F.when(_inside(roi), roi).alias("roi"), F.when(_inside(mask), mask).alias("mask"),
    )
    found = F.array(*(F.when(bad, F.lit(name)) for name, bad in rules(F.col("reject_code").isNull()).items()))
    return detection_geometry(rows).select("row.*", F.filter(found, lambda x: x.isNotNull()).alias("broken"))
