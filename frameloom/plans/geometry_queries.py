"""Registered queries over sources and geometry (``part``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import geometry, names, rational
from ..operators import settings_keys
from ..sources import probes


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source a part: sizes, aspects, rotations and colour names from its numbers; a few have odd ones."""
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda column, *values: F.element_at(F.array(*(F.lit(v) for v in values)), (column % len(values) + 1).cast("int"))
    return fx.table(spark, sf_dir, "part").select(
        k.alias("part"), (320 + 16 * size).cast("int").alias("width"), (180 + 8 * (k % 80)).cast("int").alias("height"),
        (1 + k % 4).alias("sar_num"), (1 + size % 3).cast("long").alias("sar_den"), F.when(k % 50 == 7, 45).otherwise((k % 4 * 90).cast("int")).alias("rotation"),
        pick(k, "bt709", None, "smpte2084", "BT470BG", "gamma22", "log316", "").alias("transfer"),
        pick(k + size, "bt709", None, "smpte170m", "unspecified", "bt2020nc", "bt470bg").alias("matrix_in"),
        pick(size.cast("long"), "tv", "pc", None, "JPEG", "odd").alias("range_in"), pick(k, "yuv420p", "yuv420p", "yuvj420p", "rgb24", "GBRP").alias("pixel_format"), (k % 40 == 3).alias("interlaced"),
    )


_SRC = """
sr AS MATERIALIZED (SELECT p_partkey AS part, CAST(320 + 16 * p_size AS INT) AS width, CAST(180 + 8 * (p_partkey % 80) AS INT) AS height, 1 + p_partkey % 4 AS sar_num, CAST(1 + p_size % 3 AS BIGINT) AS sar_den,
  CASE WHEN p_partkey % 50 = 7 THEN 45 ELSE CAST(p_partkey % 4 * 90 AS INT) END AS rotation, ['bt709', NULL, 'smpte2084', 'BT470BG', 'gamma22', 'log316', ''][p_partkey % 7 + 1] AS transfer,
  ['bt709', NULL, 'smpte170m', 'unspecified', 'bt2020nc', 'bt470bg'][(p_partkey + p_size) % 6 + 1] AS matrix_in, ['tv', 'pc', NULL, 'JPEG', 'odd'][p_size % 5 + 1] AS range_in,
  ['yuv420p', 'yuv420p', 'yuvj420p', 'rgb24', 'GBRP'][p_partkey % 5 + 1] AS pixel_format, p_partkey % 40 = 3 AS interlaced FROM part),
sq AS MATERIALIZED (SELECT *, greatest(1, CASE WHEN 2 * (width * sar_num % sar_den) < sar_den THEN width * sar_num // sar_den WHEN 2 * (width * sar_num % sar_den) > sar_den THEN width * sar_num // sar_den + 1
  ELSE width * sar_num // sar_den + width * sar_num // sar_den % 2 END) AS square_w FROM sr),
di AS MATERIALIZED (SELECT *, CASE WHEN rotation IN (90, 270) THEN height ELSE square_w END AS display_w, CASE WHEN rotation IN (90, 270) THEN square_w ELSE height END AS display_h FROM sq),
ca AS MATERIALIZED (SELECT *, greatest(1, CASE WHEN 2 * (display_h * cache_w % display_w) < display_w THEN display_h * cache_w // display_w WHEN 2 * (display_h * cache_w % display_w) > display_w THEN display_h * cache_w // display_w + 1
  ELSE display_h * cache_w // display_w + display_h * cache_w // display_w % 2 END) AS cache_h FROM (SELECT *, least(640, display_w) AS cache_w FROM di)),
re AS MATERIALIZED (SELECT *, 40 * (part % 3) AS rx, 30 * (part % 4) AS ry, greatest(1, display_w - 60 * (part % 5)) AS rw, greatest(1, display_h - 25 * (part % 6)) AS rh,
  CASE WHEN part % 4 <> 0 THEN 10 * (part % 9) END AS mx, CASE WHEN part % 4 <> 0 THEN 12 * (part % 5) END AS my, CASE WHEN part % 4 <> 0 THEN 30 + part % 200 END AS mw, CASE WHEN part % 4 <> 0 THEN 20 + part % 300 END AS mh FROM ca)
"""


def p02_rationals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floor, ceiling and half-even rounding of quotients, negative ones too."""
    a, b = (F.col("l_partkey") * 7 - F.col("l_orderkey")).alias("a"), (1 + F.col("l_linenumber") * 2 - F.col("l_linenumber") % 2).cast("long").alias("b")
    rows = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", a, b).distinct()
    return rows.select("l_orderkey", "a", "b", rational.div_floor(F.col("a"), F.col("b")).alias("floor"), rational.div_ceil(F.col("a"), F.col("b")).alias("ceil"), rational.div_half_even(F.col("a"), F.col("b")).alias("half_even"))


def p03_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.with_display(sources(spark, sf_dir)).select("part", "square_w", "display_w", "display_h", "cache_w", "cache_h")


def p04_color_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.with_color_policy(sources(spark, sf_dir)).select("part", "matrix", "range", "color_warning", "assumed_matrix", "reject_code")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("part")
    rect = lambda x, y, w, h: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), w.cast("long").alias("width"), h.cast("long").alias("height"))
    one = F.lit(1).cast("long")
    roi = rect(40 * (k % 3), 30 * (k % 4), F.greatest(one, F.col("display_w") - 60 * (k % 5)), F.greatest(one, F.col("display_h") - 25 * (k % 6)))
    mask = F.when(k % 4 != 0, rect(10 * (k % 9), 12 * (k % 5), 30 + k % 200, 20 + k % 300))
    return geometry.with_display(sources(spark, sf_dir)).select("part", "display_w", "display_h", "cache_w", "cache_h", roi.alias("roi"), mask.alias("mask"))


def p05_project_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = regions(spark, sf_dir).withColumn("r", geometry.project_rect(F.col("roi"), F.col("display_w"), F.col("display_h"), F.col("cache_w"), F.col("cache_h")))
    return got.select("part", F.col("r.x").alias("x"), F.col("r.y").alias("y"), F.col("r.width").alias("width"), F.col("r.height").alias("height"))


def p06_detection_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = geometry.detection_geometry(regions(spark, sf_dir))
    fine = F.col("reject_code").isNull()
    keep = lambda c, name: F.when(fine, F.col(c)).alias(name)
    return got.select("part", keep("detector_w", "detector_w"), keep("detector_h", "detector_h"), keep("excluded.x", "ex"), keep("excluded.y", "ey"), keep("excluded.width", "ew"), keep("excluded.height", "eh"), keep("mask_outside", "mask_outside"), keep("valid_count", "valid_count"), "reject_code")


def p12_sequence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "part").select("p_partkey")
    return rows.select("p_partkey", *(names.seq_id(p, F.col("p_partkey") * 701).alias(f"{p}_id") for p in "sbg"))


def p13_timeline_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return fx.table(spark, sf_dir, "part").select("p_partkey", settings_keys.timeline_version(F.when(k % 2 == 0, "half").otherwise("all"), k % 3 == 0, F.when(k % 5 < 2, "spatial").otherwise("anchor")).alias("version"))


def p14_detector_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "part").select("p_partkey", F.to_json(settings_keys.detector_struct({"tile": F.col("p_size"), "pixel_delta": F.col("p_partkey") % 50, "algorithm": F.lit("spatial")})).alias("payload"))
    return rows


def p15_settings_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose wanted settings have no published run; a rectangle counts in manual mode only."""
    k = F.col("p_partkey")
    rows = fx.table(spark, sf_dir, "part").select(k.cast("string").alias("source_id"), F.when(k % 3 == 0, "manual").otherwise("auto").alias("roi_mode"), (k % 10).alias("roi_x"), (k % 4).alias("mask_x"))
    wanted = rows.withColumn("settings_key", settings_keys.settings_key({"roi_mode": F.col("roi_mode"), "roi": F.when(F.col("roi_mode") == "manual", F.col("roi_x")), "mask": F.col("mask_x")}))
    other = rows.where("CAST(source_id AS INT) % 7 <> 0").withColumn("settings_key", settings_keys.settings_key({"mask": F.col("mask_x"), "roi": F.when(F.col("roi_mode") == "manual", F.col("roi_x") + (F.col("roi_x") == 3).cast("long")), "roi_mode": F.col("roi_mode")}))
    return settings_keys.to_reanalyse(wanted, other).select("source_id", "settings_key")


def s01_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored probe documents made of parts: a cover picture first, aspects and durations in several spellings."""
    return probes.normalize_probes(probe_documents(spark, sf_dir)).select("source_id", "stream_index", "codec", "coded_w", "coded_h", "sar_num", "sar_den", "rotation", "display_w", "display_h", "tb_num", "tb_den", "origin_pts", F.col("duration").cast("double").alias("duration"), "duration_kind", "reject_code")


def probe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    sar = F.when(k % 5 == 0, F.lit("N/A")).when(k % 5 == 1, F.lit("0:1")).otherwise(F.concat((1 + k % 4).cast("string"), F.lit(":"), (1 + size % 3).cast("string")))
    fields = [
        F.lit('"index":1,"codec_type":"video","codec_name":"h264","disposition":{"attached_pic":0}'),
        F.concat(F.lit('"width":'), (320 + 16 * size).cast("string"), F.lit(',"height":'), (180 + k % 60).cast("string")),
        F.when(k % 3 == 0, F.concat(F.lit('"coded_width":'), (336 + 16 * size).cast("string"), F.lit(',"coded_height":'), (192 + k % 60).cast("string"))),
        F.concat(F.lit('"sample_aspect_ratio":'), text(sar)),
        F.when(k % 6 != 2, F.lit('"time_base":"1/1000"')),
        F.when(k % 4 != 0, F.concat(F.lit('"duration":'), text((10 + k % 90).cast("string")))),
        F.when(k % 8 == 3, F.lit('"tags":{"rotate":"90"}')),
        F.when(k % 16 == 3, F.lit('"side_data_list":[{"rotation":0},{"rotation":-90}]')),
    ]
    picture = F.when(k % 2 == 0, F.lit('{"index":0,"codec_type":"video","codec_name":"png","width":5,"height":5,"disposition":{"attached_pic":1}},')).otherwise(F.lit('{"index":0,"codec_type":"audio","codec_name":"aac"},'))
    stream = F.when(k % 30 == 11, F.lit('{"index":1,"codec_type":"audio","codec_name":"aac"}')).otherwise(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")))
    first = F.when(k % 9 == 0, F.concat(F.lit('{"best_effort_timestamp":"N/A","pts":'), (k % 7).cast("string"), F.lit("}"))).otherwise(F.concat(F.lit('{"best_effort_timestamp":'), (k % 5).cast("string"), F.lit(',"pts":99}')))
    whole = F.concat(F.lit('{"streams":['), picture, stream, F.lit('],"frames":['), first, F.lit('],"format":{"duration":'), text(F.when(k % 20 == 4, "N/A").otherwise((20 + k % 90).cast("string"))), F.lit("}}"))
    return fx.table(spark, sf_dir, "part").select(k.cast("string").alias("source_id"), whole.alias("document"))


QUERIES = {f.__name__: f for f in (p02_rationals, p03_display, p04_color_policy, p05_project_rect, p06_detection_geometry, p12_sequence_ids, p13_timeline_version, p14_detector_payload, p15_settings_key, s01_probes)}

SQL = {
    "p02_rationals": """
WITH r AS (SELECT DISTINCT l_orderkey, l_partkey * 7 - l_orderkey AS a, CAST(1 + l_linenumber * 2 - l_linenumber % 2 AS BIGINT) AS b FROM lineitem), m AS (SELECT *, ((a % b) + b) % b AS r FROM r)
SELECT l_orderkey, a, b, (a - r) // b AS floor, CASE WHEN r = 0 THEN a // b ELSE (a - r) // b + 1 END AS ceil, CASE WHEN 2 * r < b THEN (a - r) // b WHEN 2 * r > b THEN (a - r) // b + 1 ELSE (a - r) // b + abs((a - r) // b % 2) END AS half_even FROM m
""",
    "p03_display": fx.sql("SELECT part, square_w, display_w, display_h, cache_w, cache_h FROM ca", _SRC),
    "p04_color_policy": fx.sql(
        """, n AS (SELECT *, CASE WHEN coalesce(transfer, '') = '' THEN 'unknown' ELSE lower(transfer) END AS t, CASE WHEN coalesce(matrix_in, '') = '' THEN 'unknown' ELSE lower(matrix_in) END AS m, lower(coalesce(range_in, 'unknown')) AS g,
        lower(pixel_format) IN ('rgb24', 'gbrp') AS rgb, CASE WHEN height >= 720 THEN 'bt709' ELSE 'bt601' END AS assumed FROM sr),
        o AS (SELECT *, CASE WHEN rgb THEN 'rgb' WHEN m IN ('unknown', 'unspecified') THEN assumed WHEN m IN ('bt470bg', 'smpte170m') THEN 'bt601' WHEN m = 'bt709' THEN m END AS mo,
        CASE WHEN rgb THEN 'full' WHEN g IN ('unknown', 'tv') THEN 'limited' WHEN g IN ('pc', 'jpeg') THEN 'full' END AS ro FROM n),
        p AS (SELECT *, rotation = 45 OR interlaced OR t IN ('smpte2084', 'log316') OR (rgb AND m NOT IN ('unknown', 'rgb', 'gbr')) OR mo IS NULL OR ro IS NULL AS bad FROM o)
        SELECT part, CASE WHEN NOT bad THEN mo END AS matrix, CASE WHEN NOT bad THEN ro END AS range, CASE WHEN NOT bad AND NOT rgb AND m IN ('unknown', 'unspecified') THEN 'MatrixAssumed' END AS color_warning, CASE WHEN NOT bad AND NOT rgb AND m IN ('unknown', 'unspecified') THEN assumed END AS assumed_matrix,
        CASE WHEN bad THEN 'UnsupportedDisplayTransform' END AS reject_code FROM p""",
        _SRC,
    ).replace("\n,", ",", 1),
    "p12_sequence_ids": "SELECT p_partkey, format('s{:06d}', p_partkey * 701) AS s_id, format('b{:06d}', p_partkey * 701) AS b_id, format('g{:06d}', p_partkey * 701) AS g_id FROM part",
    "p13_timeline_version": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND (p_partkey % 3 = 0 OR p_partkey % 5 < 2) THEN 7 WHEN p_partkey % 2 = 0 OR p_partkey % 5 < 2 THEN 6 ELSE 4 END AS version FROM part",
    "p14_detector_payload": """SELECT p_partkey, '{"algorithm":"spatial","pixel_delta":' || p_partkey % 50 || ',"tile":' || p_size || '}' AS payload FROM part""",
    "p15_settings_key": """SELECT CAST(p_partkey AS VARCHAR) AS source_id, sha256('{"mask":' || p_partkey % 4 || ',"roi":' || CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 10 AS VARCHAR) ELSE 'null' END || ',"roi_mode":"' || CASE WHEN p_partkey % 3 = 0 THEN 'manual' ELSE 'auto' END || '"}') AS settings_key
FROM part WHERE p_partkey % 7 = 0 OR (p_partkey % 3 = 0 AND p_partkey % 10 = 3)""",
}
_XY = """
x1 AS MATERIALIZED (SELECT *, greatest(0, least(cache_w - 1, rx * cache_w // display_w)) AS px, greatest(0, least(cache_h - 1, ry * cache_h // display_h)) AS py FROM re),
x2 AS MATERIALIZED (SELECT *, least(cache_w, greatest(px + 1, ((rx + rw) * cache_w + display_w - 1) // display_w)) - px AS pw, least(cache_h, greatest(py + 1, ((ry + rh) * cache_h + display_h - 1) // display_h)) - py AS ph, rx + rw > display_w OR ry + rh > display_h AS away FROM x1),
x3 AS MATERIALIZED (SELECT *, least(pw, 320) AS dw FROM x2),
x4 AS MATERIALIZED (SELECT *, greatest(1, CASE WHEN 2 * (ph * dw % pw) < pw THEN ph * dw // pw WHEN 2 * (ph * dw % pw) > pw THEN ph * dw // pw + 1 ELSE ph * dw // pw + ph * dw // pw % 2 END) AS dh,
  greatest(rx, mx) AS ax, greatest(ry, my) AS ay, least(rx + rw, mx + mw) AS bx, least(ry + rh, my + mh) AS byy FROM x3),
x5 AS MATERIALIZED (SELECT *, coalesce(ax < bx AND ay < byy AND mx IS NOT NULL, false) AS meets FROM x4),
x6 AS MATERIALIZED (SELECT *, CASE WHEN meets THEN greatest(0, (ax - rx) * dw // rw - 1) END AS ex, CASE WHEN meets THEN greatest(0, (ay - ry) * dh // rh - 1) END AS ey,
  CASE WHEN meets THEN least(dw, ((bx - rx) * dw + rw - 1) // rw + 1) END AS fx, CASE WHEN meets THEN least(dh, ((byy - ry) * dh + rh - 1) // rh + 1) END AS fy FROM x5),
x7 AS MATERIALIZED (SELECT *, dw * dh - coalesce((fx - ex) * (fy - ey), 0) AS vc FROM x6),
x8 AS MATERIALIZED (SELECT *, CASE WHEN away THEN 'InvalidRegion' WHEN dw < 64 OR dh < 36 THEN 'DetectorTooSmall' WHEN mx IS NOT NULL AND (mx + mw > display_w OR my + mh > display_h) THEN 'InvalidMask' WHEN vc < greatest(64, (dw * dh + 19) // 20) THEN 'InsufficientPixels' END AS code FROM x7)
"""
SQL["p05_project_rect"] = fx.sql("SELECT part, CASE WHEN NOT away THEN px END AS x, CASE WHEN NOT away THEN py END AS y, CASE WHEN NOT away THEN pw END AS width, CASE WHEN NOT away THEN ph END AS height FROM x2", _SRC, _XY)
SQL["p06_detection_geometry"] = fx.sql(
    """SELECT part, CASE WHEN code IS NULL THEN dw END AS detector_w, CASE WHEN code IS NULL THEN dh END AS detector_h, CASE WHEN code IS NULL THEN ex END AS ex, CASE WHEN code IS NULL THEN ey END AS ey,
    CASE WHEN code IS NULL THEN fx - ex END AS ew, CASE WHEN code IS NULL THEN fy - ey END AS eh, CASE WHEN code IS NULL THEN mx IS NOT NULL AND (ax <> mx OR ay <> my OR bx <> mx + mw OR byy <> my + mh) END AS mask_outside, CASE WHEN code IS NULL THEN vc END AS valid_count, code AS reject_code FROM x8""",
    _SRC, _XY,
)
SQL["s01_probes"] = """
WITH k AS (SELECT p_partkey AS k, p_size AS z FROM part),
a AS (SELECT k, z, k % 30 = 11 AS none, CASE WHEN k % 16 = 3 THEN 270 WHEN k % 8 = 3 THEN 90 ELSE 0 END AS rotation, CASE WHEN k % 5 < 2 THEN 1 ELSE 1 + k % 4 END AS sn, CASE WHEN k % 5 < 2 THEN 1 ELSE 1 + z % 3 END AS sd, 320 + 16 * z AS w, 180 + k % 60 AS h FROM k),
g AS (SELECT *, gcd(sn, sd) AS q, CASE WHEN 2 * (w * sn % sd) < sd THEN w * sn // sd WHEN 2 * (w * sn % sd) > sd THEN w * sn // sd + 1 ELSE w * sn // sd + w * sn // sd % 2 END AS sw FROM a),
c AS (SELECT *, CASE WHEN none THEN 'InvalidTiming' WHEN k % 6 = 2 THEN 'InvalidTiming' WHEN k % 4 = 0 AND k % 20 = 4 THEN 'InvalidTiming' END AS code FROM g)
SELECT CAST(k AS VARCHAR) AS source_id, CASE WHEN NOT none THEN 1 END AS stream_index, CASE WHEN NOT none THEN 'h264' END AS codec, CASE WHEN NOT none THEN w + CASE WHEN k % 3 = 0 THEN 16 ELSE 0 END END AS coded_w,
CASE WHEN NOT none THEN h + CASE WHEN k % 3 = 0 THEN 12 ELSE 0 END END AS coded_h, CASE WHEN NOT none THEN sn // q END AS sar_num, CASE WHEN NOT none THEN sd // q END AS sar_den, CASE WHEN NOT none THEN rotation END AS rotation,
CASE WHEN NOT none THEN CASE WHEN rotation IN (90, 270) THEN h ELSE sw END END AS display_w, CASE WHEN NOT none THEN CASE WHEN rotation IN (90, 270) THEN sw ELSE h END END AS display_h,
CASE WHEN NOT none AND k % 6 <> 2 THEN 1 END AS tb_num, CASE WHEN NOT none AND k % 6 <> 2 THEN 1000 END AS tb_den, CASE WHEN k % 9 = 0 THEN k % 7 ELSE k % 5 END AS origin_pts,
CASE WHEN none THEN NULL WHEN k % 4 <> 0 THEN CAST(10 + k % 90 AS DOUBLE) WHEN k % 20 <> 4 THEN CAST(20 + k % 90 AS DOUBLE) END AS duration, CASE WHEN none THEN NULL WHEN k % 4 <> 0 THEN 'video_metadata' WHEN k % 20 <> 4 THEN 'container_estimate' END AS duration_kind, code AS reject_code FROM c
"""
