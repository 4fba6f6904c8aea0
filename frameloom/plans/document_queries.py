"""Registered queries: frame checks, table functions, documents, their rules, and publication."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import pixels, tables
from ..operators import anchor, segments, tiles, validate
from ..sources import frames as frame_source
from ..sources import timelines as documents
from . import detector_queries, flagship, frame_queries, publish, timelines
from .staging import shared_folder, staged


def _binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with their gray as one binary value."""
    chars = F.transform("px", lambda v: F.lpad(F.hex(v.cast("long")), 2, "0"))
    return fx.frames(spark, sf_dir).select("source_id", "ordinal", "pts", "width", "height", F.unhex(F.array_join(chars, "")).alias("gray"))


def s03_frame_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source 2 has a short payload, source 4 a time that falls back, source 6 a second size."""
    rows = _binary(spark, sf_dir)
    source, n = F.col("source_id"), F.col("ordinal")
    odd = rows.withColumn("gray", F.when((source == "2") & (n == 7), F.substring("gray", 1, 63)).otherwise(F.col("gray"))).withColumn("pts", F.when((source == "4") & (n == 9), F.col("pts") - 5000).otherwise(F.col("pts")))
    odd = odd.withColumn("width", F.when((source == "6") & (n > 3), 4).otherwise(8)).withColumn("height", F.when((source == "6") & (n > 3), 16).otherwise(8))
    good, bad = frame_source.check_frames(odd)
    return good.groupBy("source_id").agg(F.count("*").alias("n")).withColumn("reject_code", F.lit(None).cast("string")).unionByName(bad.withColumn("n", F.lit(0).cast("long")))


def p10_binary_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numpy kernel over binary frames; the same as the array form."""
    cut = tiles.split_tiles_binary(_binary(spark, sf_dir), fx.SMALL.tile, fx.SMALL.edge_delta)
    return cut.select("source_id", "ordinal", "ty", "tx", F.array_join(F.transform("px", lambda v: v.cast("string")), " ").alias("px"), F.size(F.filter("edge", lambda x: x)).cast("long").alias("n_edges"))


def p09_prepare_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour frames (v, v div 2, 255 - v), cut to 6 x 4 pixels and averaged to 3 x 2."""
    hexed = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")
    rgb = F.unhex(F.array_join(F.transform("px", lambda v: F.concat(hexed(v), hexed(F.floor(v / 2)), hexed(F.lit(255) - v))), ""))
    cut = F.struct(F.lit(1).alias("x"), F.lit(2).alias("y"), F.lit(6).alias("width"), F.lit(4).alias("height"))
    rows = fx.frames(spark, sf_dir).select("source_id", "ordinal", "pts", "width", "height", rgb.alias("rgb"), cut.alias("cached"), F.lit(3).alias("detector_w"), F.lit(2).alias("detector_h"))
    return frame_source.prepare_frames(rows).select("source_id", "ordinal", F.hex("gray").alias("gray"))


def p17_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that grow with the source; those of sources 7 and up leave the frame."""
    label = F.col("source_id").cast("int")
    roi = F.struct(F.lit(1).alias("x"), F.lit(2).alias("y"), (label + 1).alias("width"), F.lit(3).alias("height"))
    got = tiles.crop(fx.frames(spark, sf_dir).withColumn("roi", roi))
    return got.select("source_id", "ordinal", "width", "height", F.array_join(F.transform("px", lambda v: v.cast("string")), " ").alias("px"), "reject_code")


def u01_sql_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px_changed and px_edges in SQL, over each frame and its reverse."""
    pixels.register(spark)
    fx.frames(spark, sf_dir).createOrReplaceTempView("u01_frames")
    return spark.sql("SELECT source_id, ordinal, size(filter(px_changed(px, reverse(px), 60), x -> x)) AS n_changed, size(filter(px_edges(px, width, 60), x -> x)) AS n_edges FROM u01_frames")


def u03_frame_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark)
    _binary(spark, sf_dir).createOrReplaceTempView("u03_frames")
    got = spark.sql("SELECT * FROM frame_tiles(TABLE(u03_frames), 3)")
    digits = F.transform(F.sequence(F.lit(1), F.octet_length("px")), lambda i: F.conv(F.hex(F.substring("px", i, F.lit(1))), 16, 10))
    return got.select("source_id", "ordinal", "ty", "tx", F.array_join(digits, " ").alias("px"))


def s06_simple_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.simple_documents(frame_queries.w05_navigation(spark, sf_dir))


def _described(sources: DataFrame, **more) -> DataFrame:
    """A description of each source, as a probe and an editor would give it."""
    long = lambda v: F.lit(v).cast("long")
    hash_ = F.sha2("source_id", 256)
    rect = F.struct(long(0).alias("x"), long(0).alias("y"), long(64).alias("width"), long(48).alias("height"))
    source = F.struct(
        F.concat(F.lit("lecture-"), "source_id", F.lit(".mp4")).alias("basename"), long(1000).alias("size_bytes"), long(1).alias("mtime_ns"), hash_.alias("chunk_sha256"), long(0).alias("stream_index"), F.lit("h264").alias("codec"), long(64).alias("coded_width"), long(48).alias("coded_height"),
        long(1).alias("sar_num"), long(1).alias("sar_den"), long(0).alias("rotation_cw"), long(64).alias("display_width"), long(48).alias("display_height"), long(1).alias("time_base_num"), long(1000).alias("time_base_den"), "origin_pts", F.lit("first_display_frame").alias("time_origin"),
    )
    artifact = F.struct(
        F.lit("00000000-0000-4000-8000-000000000000").alias("export_id"), long(0).alias("project_revision"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.lit("1").alias("generator_version"), F.concat("source_id", F.lit(".slides.pdf")).alias("pdf_basename"), hash_.alias("pdf_sha256")
    )
    return sources.select("source_id", source.alias("source"), rect.alias("roi"), artifact.alias("artifact"), F.lit(64).alias("cache_w"), F.lit(48).alias("cache_h"), *(c.alias(n) for n, c in more.items()))


def _spatial_run(frames: DataFrame, sources: DataFrame, samples: DataFrame) -> timelines.Findings:
    run = flagship.analyse(frames, sources, samples, fx.SMALL)
    pairs, numbered, reps = staged(run.pairs), staged(run.numbered), staged(run.reps)
    bounds = staged(segments.segment_bounds(numbered, sources))
    closed = bounds.join(reps.select("source_id", "segment_ix", "rep_ordinal"), ["source_id", "segment_ix"])
    pages = segments.pages_of_segments(closed).join(samples.select("source_id", F.col("ordinal").alias("rep_ordinal"), "ticks"), ["source_id", "rep_ordinal"])
    return timelines.Findings(segments.boundaries(numbered, pairs), closed, pages, segments.navigation(pages, sources))


def detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spatial documents of all frames (version 6)."""
    frames = fx.frames(spark, sf_dir)
    sources = staged(fx.frame_sources(frames))
    samples = staged(fx.timed_samples(frames, sources))
    return staged(timelines.detailed_documents(_spatial_run(frames, sources, samples), samples, sources, _described(sources), fx.SMALL))


def half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spatial documents of every second frame, with all samples in the index (version 7); two of three sources have a mask."""
    frames = fx.frames(spark, sf_dir)
    sources = staged(fx.frame_sources(frames))
    samples = staged(fx.timed_samples(frames, sources))
    run = _spatial_run(frames.where("ordinal % 2 = 0"), sources, samples.where("ordinal % 2 = 0"))
    long = lambda v: F.lit(v).cast("long")
    mask = F.when(F.col("source_id").cast("int") % 3 != 0, F.struct(long(32).alias("x"), long(0).alias("y"), long(32).alias("width"), long(48).alias("height")))
    described = _described(sources, mask=mask, policy=F.lit("half"), index_complete=F.lit(True))
    return staged(timelines.detailed_documents(run, samples, sources, described, fx.SMALL))


def anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the anchor detector: of all samples (version 4), or, for odd sources, of a half index without the others (version 6)."""
    frames = fx.frames(spark, sf_dir)
    sources = staged(fx.frame_sources(frames))
    samples = staged(fx.timed_samples(frames, sources))
    groups = staged(anchor.anchor_groups(frames.join(samples.select("source_id", "ordinal", "ticks"), ["source_id", "ordinal"]), fx.SMALL_ANCHOR, scored=True))
    described = _described(sources, policy=F.when(F.col("source_id").cast("int") % 2 == 0, "all").otherwise("half"))
    return staged(timelines.detailed_documents(timelines.anchor_findings(groups, samples, sources), samples, sources, described, fx.SMALL_ANCHOR))


def _told(rows: DataFrame) -> DataFrame:
    """Documents read back strictly: sizes and ends of what they hold, and the rules they break."""
    good, _ = documents.parse(rows)
    told = validate.violations(good)
    return told.select(
        "source_id", F.col("d.schema_version").alias("version"), *(F.size(f"d.{c}").cast("long").alias(n) for c, n in (("samples", "n_samples"), ("detected_boundaries", "n_boundaries"), ("detected_segments", "n_segments"), ("pages", "n_pages"))),
        F.element_at("d.navigation_ranges", -1)["end_s"].alias("end_s"), F.array_join(F.transform("d.pages", lambda p: p["representative_sample_id"]), ",").alias("representatives"), F.array_join("broken", ",").alias("broken"), "d",
    )


def s07_detailed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(detailed(spark, sf_dir)).drop("d")


def s07_half_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _told(half(spark, sf_dir))
    return told.select("*", F.size(F.filter("d.samples", lambda x: x["is_analysis_observation"])).cast("long").alias("n_observed"), F.size("d.ignore_masks").cast("long").alias("n_masks")).drop("d")


def s07_anchor_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _told(anchored(spark, sf_dir))
    return told.select("*", F.size(F.filter("d.detected_boundaries", lambda x: x["status"] == "confirmed")).cast("long").alias("n_confirmed")).drop("d")


#: One change of a document's text for each rule, and what must be said of it.
MUTATIONS = {
    "duplicate": (r'^\{"schema_version":6', '{"schema_version":6,"schema_version":6', "json: duplicate field"),
    "nan": (r'"duration_s":[0-9.]+', '"duration_s":NaN', "json: not a finite number"),
    "trailing": (r"\}$", "} {}", "json: malformed"),
    "missing": (r'"duration_kind":"video_metadata",', "", "document: fields"),
    "extra": (r'"basename":', '"more":1,"basename":', "source: fields"),
    "float": (r'"schema_version":6', '"schema_version":6.0', "schema_version: type"),
    "boolean": (r'"ordinal":1,', '"ordinal":true,', "ordinal: type"),
    "null": (r'"codec":"h264"', '"codec":null', "codec: null"),
    "source": (r'"rotation_cw":0', '"rotation_cw":45', "V2.source"),
    "region": (r'"roi":\{"x":0', '"roi":{"x":1', "V3.region"),
    "sample": (r'"sample_id":"s000001"', '"sample_id":"s000009"', "V4.samples"),
    "policy": (r'"selection_policy":"all"', '"selection_policy":"half"', "V5.observation"),
    "boundary": (r'"persistence_samples":1', '"persistence_samples":2', "V6.boundaries"),
    "segment": (r'"start_boundary_id":null', '"start_boundary_id":"b000000"', "V7.segments"),
    "page": (r'"pdf_page":1,', '"pdf_page":2,', "V8.pages"),
    "navigation": (r'"is_slide_boundary":false', '"is_slide_boundary":true', "V8.navigation"),
    "artifact": (r'"created_at":"2024', '"created_at":"24', "V8.artifact"),
    "version 4": (r'^\{"schema_version":6(.*),"selection_policy":"all"', '{"schema_version":4$1', "detector: fields"),
    "version 5": (r'^\{"schema_version":6(.*),"selection_policy":"all"', '{"schema_version":5$1', ""),
    "version 7": (r'"schema_version":6', '"schema_version":7', "sampling: fields"),
}


#: The same for half and for anchor documents.
HALF_MUTATIONS = {
    "policy": (r'"selection_policy":"half"', '"selection_policy":"third"', "V5.observation,V6.boundaries,V7.segments"),
    "all observed": (r'"selection_policy":"half"', '"selection_policy":"all"', "V5.observation,V6.boundaries,V7.segments"),
    "not observed": (r'"is_analysis_observation":true', '"is_analysis_observation":false', "V5.observation"),
    "input": (r'"input_policy":"half"', '"input_policy":"all"', "V5.observation"),
    "no flag": (r'"keyframe_index_complete":true', '"keyframe_index_complete":1', "keyframe_index_complete: type"),
    "version 6": (r'"schema_version":7', '"schema_version":6', "sampling: fields"),
    "version 8": (r'"schema_version":7', '"schema_version":8', "schema_version: unknown"),
    "index": (r'"keyframe_index_complete":true', '"keyframe_index_complete":false', "V5.observation,V6.boundaries,V7.segments"),
}
ANCHOR_MUTATIONS = {
    "algorithm": (r'"algorithm":"masked-anchor-tile-v1"', '"algorithm":"other"', "V5.observation"),
    "debounce": (r'"debounce_samples":2', '"debounce_samples":3', "V5.observation"),
    "share": (r'"min_tile_valid_fraction":0.5', '"min_tile_valid_fraction":0.25', "V5.observation"),
    "stride": (r'"tile_stride":[0-9]+', '"tile_stride":0', "V5.observation"),
    "threshold": (r'"global_mad":[0-9.]+,"tile_mad"', '"global_mad":1.5,"tile_mad"', "V5.observation"),
    "flag": (r'"keep_unconfirmed":true', '"keep_unconfirmed":1', "keep_unconfirmed: type"),
    "spatial": (r'"debounce_samples":2', '"debounce_samples":2,"input_policy":"all"', "detector: fields"),
}


def _mutated(base: DataFrame, mutations: dict) -> DataFrame:
    """(source_id, mutation, said): every document, unchanged and with one fault each: what the strict reader or the rules say."""
    first = lambda find, put: F.expr(f"regexp_replace(document, {_quoted(find)}, {_quoted(put)})")
    changes = [F.struct(F.lit("none").alias("fault"), F.col("document").alias("text"))] + [F.struct(F.lit(n).alias("fault"), first(f, p).alias("text")) for n, (f, p, _) in mutations.items()]
    rows = base.select("source_id", F.explode(F.array(*changes)).alias("m")).select("source_id", F.col("m.fault").alias("mutation"), F.col("m.text").alias("document"))
    good, bad = documents.parse(rows)
    said = validate.violations(good).select("source_id", "mutation", F.array_join("broken", ",").alias("said"))
    return said.unionByName(bad.select("source_id", "mutation", F.col("fault").alias("said")))


def v01_document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mutated(detailed(spark, sf_dir), MUTATIONS)


def v01_half_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mutated(half(spark, sf_dir), HALF_MUTATIONS)


def v01_anchor_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mutated(anchored(spark, sf_dir), ANCHOR_MUTATIONS)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def s08_page_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = fx.frames(spark, sf_dir).drop("ordinal")
    timed = fx.frames(spark, sf_dir).select("source_id", F.col("ordinal").alias("rep_ordinal"), "pts")
    roi = F.struct(F.lit(2).alias("x"), F.lit(1).alias("y"), F.lit(5).alias("width"), F.lit(6).alias("height"))
    pages = segments.ranked(frame_queries.analysis(spark, sf_dir).pages).join(timed, ["source_id", "rep_ordinal"]).select("source_id", "page", "pts", roi.alias("roi"))
    rows, _ = publish.page_frames(pages, frames)
    return rows.select("source_id", "page", "pts", "width", "height", F.array_join(F.transform("px", lambda v: v.cast("string")), " ").alias("px"))


def s09_incremental_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run after two sources have lost their later frames and one has gone: only those two are analysed again."""
    from . import flagship, incremental

    frames = fx.frames(spark, sf_dir)
    later = frames.where("source_id <> '9' AND NOT (source_id IN ('3', '5') AND ordinal >= 20)")
    store = publish.Store(spark, f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}")

    def listing(rows: DataFrame) -> DataFrame:
        return rows.groupBy("source_id").agg(F.count("*").alias("size_bytes"), F.sum("pts").cast("string").alias("fingerprint")).withColumn("settings_key", F.lit("k"))

    def analysed(rows: DataFrame):
        def work(asked: DataFrame) -> dict[str, DataFrame]:
            own = rows.join(asked, "source_id", "left_semi")
            sources = fx.frame_sources(own)
            return {"pages": flagship.analyse(own, sources, fx.timed_samples(own, sources), fx.SMALL).pages.select("source_id", "page_id", "ticks")}

        return work

    incremental.incremental_run(store, "r1", listing(frames), analysed(frames))
    incremental.incremental_run(store, "r2", listing(later), analysed(later), "r1")
    return store.read("r2", "pages").join(store.read("r2", "lineage"), "source_id").select("source_id", "page_id", "ticks", "from_run", "change")


def s09_publish_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and bounds published as one run, and read back through the manifest."""
    found = frame_queries.analysis(spark, sf_dir)
    store = publish.Store(spark, f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}")
    store.publish("r1", {"pages": found.pages.select("source_id", "page_id", "ticks"), "bounds": found.bounds}, guards={"navigation": found.navigation.where("reject_code IS NOT NULL")})
    manifest = store.runs().where("name = 'pages'").select("run_id", "n_rows", "status")
    return store.read("r1", "pages").withColumn("run_id", F.lit("r1")).join(manifest, "run_id").select("source_id", "page_id", "ticks", "run_id", "n_rows", "status")


QUERIES = {f.__name__: f for f in (s03_frame_check, p10_binary_tiles, p09_prepare_frames, p17_crop, u01_sql_pixels, u03_frame_tiles, s06_simple_documents, s07_detailed_documents, s07_half_documents, s07_anchor_documents, v01_document_rules, v01_half_rules, v01_anchor_rules, s08_page_frames, s09_incremental_run, s09_publish_run)}

_F, _S, _R = fx.FRAMES_SQL, fx.SEGMENTS_SQL, fx.REPRESENTATIVES_SQL
#: The same over every second frame.
_HALF = (_F.replace("range(1, 65) t(i)", "range(1, 65) t(i) WHERE ordinal % 2 = 0"), _S.replace("q.ordinal + 1", "q.ordinal + 2"), _R)


def _mutations_sql(mutations: dict) -> str:
    faults = ", ".join(f"('{n}', '{said}')" for n, (_, _, said) in {"none": ("", "", ""), **mutations}.items())
    return f"SELECT source_id, mutation, said FROM (SELECT DISTINCT CAST(label AS VARCHAR) AS source_id FROM embeddings), (VALUES {faults}) m(mutation, said)"


_NAV = frame_queries.SQL["w05_navigation"]
SQL = {
    "s03_frame_check": fx.sql("SELECT source_id, CASE WHEN source_id IN ('2', '4', '6') THEN 0 ELSE count(*) END AS n, CASE source_id WHEN '2' THEN 'DecodeFailed' WHEN '4' THEN 'InvalidTiming' WHEN '6' THEN 'SourceChanged' END AS reject_code FROM k GROUP BY source_id", _F),
    "p10_binary_tiles": frame_queries.SQL["p10_split_tiles"],
    "p09_prepare_frames": fx.sql(
        """, gy AS (SELECT source_id, ordinal, (y - 2) // 2 AS gy, (x - 1) // 2 AS gx, round_even(CAST(v AS DOUBLE) * 0.299e0 + CAST(v // 2 AS DOUBLE) * 0.587e0 + CAST(255 - v AS DOUBLE) * 0.114e0, 0) AS w FROM p WHERE y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 6),
        gm AS (SELECT source_id, ordinal, gy, gx, CAST(round_even(sum(w) / 4, 0) AS INT) AS m FROM gy GROUP BY ALL)
        SELECT source_id, ordinal, string_agg(printf('%02X', m), '' ORDER BY gy, gx) AS gray FROM gm GROUP BY ALL""",
        _F,
    ).replace("\n,", ",", 1),
    "p17_crop": fx.sql(
        """SELECT source_id, ordinal, CASE WHEN fits THEN CAST(source_id AS INT) + 1 END AS width, CASE WHEN fits THEN 3 END AS height, CASE WHEN fits THEN string_agg(CAST(v AS VARCHAR), ' ' ORDER BY y, x) FILTER (y BETWEEN 2 AND 4 AND x BETWEEN 1 AND 1 + CAST(source_id AS INT)) END AS px,
        CASE WHEN NOT fits THEN 'InvalidRegion' END AS reject_code FROM (SELECT *, CAST(source_id AS INT) <= 6 AS fits FROM p) GROUP BY source_id, ordinal, fits""",
        _F,
    ),
    "u01_sql_pixels": fx.sql("SELECT a.source_id, a.ordinal, CAST(count(*) FILTER (abs(a.v - b.v) > 60) AS INT) AS n_changed, CAST(count(*) FILTER (a.edge) AS INT) AS n_edges FROM e a JOIN p b ON a.source_id = b.source_id AND a.ordinal = b.ordinal AND b.y = 7 - a.y AND b.x = 7 - a.x GROUP BY ALL", _F, _S),
    "u03_frame_tiles": fx.sql("SELECT source_id, ordinal, y // 3 AS ty, x // 3 AS tx, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY y, x) AS px FROM p GROUP BY ALL", _F),
    "s06_simple_documents": f"""SELECT source_id, '{{"slides":[' || string_agg('{{"page":' || page || ',"start":' || start_s || ',"end":' || end_s || '}}', ',' ORDER BY page) || ']}}' AS document FROM ({_NAV}) GROUP BY source_id""",
    "s07_detailed_documents": fx.sql(
        """SELECT source_id, 6 AS version, (SELECT count(*) FROM s WHERE s.source_id = g.source_id) AS n_samples, count(*) - 1 AS n_boundaries, count(*) AS n_segments, count(*) AS n_pages, (SELECT duration_ticks / 1000 FROM d WHERE d.source_id = g.source_id) AS end_s,
        string_agg(format('s{:06d}', rep_ordinal), ',' ORDER BY ticks) AS representatives, '' AS broken FROM g GROUP BY source_id""",
        _F, _S, _R,
    ),
    "s07_half_documents": fx.sql(
        """SELECT source_id, 7 AS version, (SELECT count(*) FROM s WHERE s.source_id = g.source_id) AS n_samples, count(*) - 1 AS n_boundaries, count(*) AS n_segments, count(*) AS n_pages, (SELECT duration_ticks / 1000 FROM d WHERE d.source_id = g.source_id) AS end_s,
        string_agg(format('s{:06d}', rep_ordinal), ',' ORDER BY ticks) AS representatives, '' AS broken, (SELECT count(*) FROM s WHERE s.source_id = g.source_id AND ordinal % 2 = 0) AS n_observed, CAST(CAST(source_id AS INT) % 3 <> 0 AS BIGINT) AS n_masks FROM g GROUP BY source_id""",
        *_HALF,
    ),
    "s07_anchor_documents": fx.sql(
        f"""SELECT source_id, CASE WHEN CAST(source_id AS INT) % 2 = 0 THEN 4 ELSE 6 END AS version, (SELECT count(*) FROM s WHERE s.source_id = w.source_id) AS n_samples, count(*) - 1 AS n_boundaries, count(*) AS n_segments, count(*) AS n_pages,
        (SELECT duration_ticks / 1000 FROM d WHERE d.source_id = w.source_id) AS end_s, string_agg(format('s{{:06d}}', rep_ordinal), ',' ORDER BY group_ix) AS representatives, '' AS broken, count(*) FILTER (status = 'confirmed') AS n_confirmed
        FROM ({detector_queries.SQL["w08_anchor_detector"]}) w GROUP BY source_id""",
        _F,
    ),
    "v01_document_rules": _mutations_sql(MUTATIONS),
    "v01_half_rules": _mutations_sql(HALF_MUTATIONS),
    "v01_anchor_rules": _mutations_sql(ANCHOR_MUTATIONS),
    "s08_page_frames": fx.sql(
        """SELECT g.source_id, page, pts, 5 AS width, 6 AS height, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY y, x) AS px FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source_id ORDER BY ticks) AS INT) AS page FROM g) g
        JOIN k ON k.source_id = g.source_id AND k.ordinal = g.rep_ordinal JOIN p ON p.source_id = g.source_id AND p.ordinal = g.rep_ordinal WHERE x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 6 GROUP BY ALL""",
        _F, _S, _R,
    ),
    "s09_incremental_run": fx.sql(
        "SELECT source_id, page_id, ticks, CASE WHEN source_id IN ('3', '5') THEN 'r2' ELSE 'r1' END AS from_run, CASE WHEN source_id IN ('3', '5') THEN 'size_bytes,fingerprint' END AS change FROM g",
        _F.replace("vec_id, embedding FROM embeddings)", "vec_id, embedding FROM embeddings QUALIFY label <> 9 AND NOT (label IN (3, 5) AND row_number() OVER (PARTITION BY label ORDER BY vec_id) > 20))"), _S, _R,
    ),
    "s09_publish_run": fx.sql("SELECT source_id, page_id, ticks, 'r1' AS run_id, (SELECT count(*) FROM g) AS n_rows, 'published' AS status FROM g", _F, _S, _R),
}
