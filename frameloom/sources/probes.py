"""Stored stream descriptions (JSON documents) to the table of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import with_color_policy, with_display

#: Every leaf is read as text, so that numbers and their spellings in strings are taken alike.
PROBE_SCHEMA = (
    "streams ARRAY<STRUCT<index:STRING,codec_type:STRING,codec_name:STRING,width:STRING,height:STRING,coded_width:STRING,coded_height:STRING,sample_aspect_ratio:STRING,"
    "time_base:STRING,duration:STRING,color_space:STRING,color_range:STRING,color_transfer:STRING,pix_fmt:STRING,field_order:STRING,"
    "disposition:STRUCT<attached_pic:STRING>,tags:STRUCT<rotate:STRING>,side_data_list:ARRAY<STRUCT<rotation:STRING>>>>,"
    "format STRUCT<duration:STRING>,frames ARRAY<STRUCT<best_effort_timestamp:STRING,pts:STRING>>"
)
INVALID = "InvalidTiming"


def _whole(text: Column) -> Column:
    return text.try_cast("long")


def _positive(text: Column) -> Column:
    """A finite decimal above zero, else null ("N/A", "nan", "inf" and signs of anything else too)."""
    value = text.try_cast("decimal(38,18)")
    return F.when(value > 0, value)


def _ratio(text: Column) -> tuple[Column, Column]:
    """Numerator and denominator of ``a:b`` or ``a/b`` in lowest terms; both null if there is no such ratio."""
    parts = F.split(text, "[:/]")
    a, b = _whole(F.get(parts, F.lit(0))), F.coalesce(_whole(F.get(parts, F.lit(1))), F.when(F.size(parts) == 1, F.lit(1).cast("long")))
    common = _gcd(a, b)
    sound = (a > 0) & (b > 0)
    return F.when(sound, F.call_function("div", a, common)), F.when(sound, F.call_function("div", b, common))


def _gcd(a: Column, b: Column, rounds: int = 90) -> Column:
    """Euclid's steps as one fold; longs need 90 at most. Null or non-positive parts give null."""
    begin = F.struct(a.alias("a"), b.alias("b"))
    step = lambda s, _: F.when(s["b"] > 0, F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] > 0, s["b"])).alias("b"))).otherwise(s)
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, step, lambda s: s["a"])
    return F.when((a > 0) & (b > 0), folded)


def normalize_probes(documents: DataFrame) -> DataFrame:
    """The table of sources of (source_id, document); a row that fails has a reject code, never an exception."""
    info = documents.withColumn("i", F.from_json("document", PROBE_SCHEMA))
    video = F.filter("i.streams", lambda s: (s["codec_type"] == "video") & (F.coalesce(_whole(s["disposition"]["attached_pic"]), F.lit(0)) != 1))
    rows = info.withColumn("s", F.get(video, F.lit(0)))
    nonzero = lambda c: F.when(_whole(c) != 0, _whole(c))
    aspect = F.coalesce("s.sample_aspect_ratio", F.lit("1:1"))
    aspect = F.when(aspect.isin("N/A", "0:1", "0/1"), F.lit("1:1")).otherwise(aspect)
    turns = F.filter(F.transform(F.coalesce("s.side_data_list", F.expr("array()")), lambda x: x["rotation"]), lambda r: r.isNotNull())
    turn = F.coalesce(F.try_element_at(turns, F.lit(-1)), F.col("s.tags.rotate"), F.lit("0")).try_cast("double")
    sar_num, sar_den = _ratio(aspect)
    tb_num, tb_den = _ratio(F.col("s.time_base"))
    times = F.flatten(F.transform(F.coalesce("i.frames", F.expr("array()")), lambda f: F.array(f["best_effort_timestamp"], f["pts"])))
    own, whole = _positive(F.col("s.duration")), _positive(F.col("i.format.duration"))
    rows = rows.select(
        "source_id",
        _whole(F.col("s.index")).cast("int").alias("stream_index"),
        F.when(F.col("s").isNotNull(), F.coalesce("s.codec_name", F.lit("unknown"))).alias("codec"),
        F.coalesce(nonzero(F.col("s.coded_width")), _whole(F.col("s.width"))).cast("int").alias("coded_w"),
        F.coalesce(nonzero(F.col("s.coded_height")), _whole(F.col("s.height"))).cast("int").alias("coded_h"),
        F.coalesce(nonzero(F.col("s.width")), _whole(F.col("s.coded_width"))).cast("int").alias("width"),
        F.coalesce(nonzero(F.col("s.height")), _whole(F.col("s.coded_height"))).cast("int").alias("height"),
        F.when(F.col("s").isNotNull(), sar_num).alias("sar_num"), F.when(F.col("s").isNotNull(), sar_den).alias("sar_den"),
        F.when(F.col("s").isNotNull(), F.pmod(turn.cast("long"), F.lit(360)).cast("int")).alias("rotation"),
        tb_num.alias("tb_num"), tb_den.alias("tb_den"),
        _whole(F.get(F.filter(times, lambda t: t.isNotNull() & (t != "N/A")), F.lit(0))).alias("origin_pts"),
        F.when(F.col("s").isNotNull(), F.coalesce(own, whole)).alias("duration"),
        F.when(F.col("s").isNotNull(), F.when(own.isNotNull(), "video_metadata").when(whole.isNotNull(), "container_estimate")).alias("duration_kind"),
        F.col("s.color_space").alias("matrix_in"), F.col("s.color_range").alias("range_in"), F.col("s.color_transfer").alias("transfer"),
        F.coalesce("s.pix_fmt", F.lit("yuv420p")).alias("pixel_format"),
        (~F.coalesce("s.field_order", F.lit("progressive")).isin("unknown", "progressive")).alias("interlaced"),
    )
    shown = with_color_policy(with_display(rows)).withColumnRenamed("reject_code", "display_code")
    needed = ("stream_index", "coded_w", "coded_h", "sar_num", "rotation", "tb_num", "origin_pts", "duration")
    failed = F.greatest(*(F.col(c).isNull() for c in needed)) | (F.least("coded_w", "coded_h", "width", "height") <= 0)
    return shown.withColumn("reject_code", F.when(failed, F.lit(INVALID)).otherwise(F.col("display_code"))).drop("display_code")
