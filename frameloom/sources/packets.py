"""Key-packet indexes: lines of ``key=value`` fields split by pipes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scans

INVALID = "InvalidTiming"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, line_no, value) of text files, one source a file; lines keep their order in a file."""
    text = spark.read.text(path, wholetext=True).withColumn("source_id", F.input_file_name())
    return text.select("source_id", F.posexplode(F.split("value", "\n")).alias("line_no", "value")).where("value <> ''")


def parse_packets(lines: DataFrame) -> DataFrame:
    """(source_id, line_no, pts, is_key, reject_code) of the lines whose flags hold a K; others are dropped."""
    fields = F.filter(F.split("value", r"\|"), lambda x: F.contains(x, F.lit("=")))

    def last(name: str):
        """The value of the last field of that name."""
        own = F.filter(fields, lambda x: F.startswith(x, F.lit(f"{name}=")))
        return F.substring(F.try_element_at(own, F.lit(-1)), len(name) + 2, 1 << 30)

    keys = lines.where(F.contains(last("flags"), F.lit("K"))).withColumn("pts", last("pts").try_cast("long"))
    return keys.select("source_id", "line_no", "pts", F.lit(True).alias("is_key"), F.when(F.col("pts").isNull(), F.lit(INVALID)).alias("reject_code"))


def key_packets(lines: DataFrame, origins: DataFrame, stretch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(packets, rejects): key packets of sound sources, and per rejected source its code.

    A source is rejected as a whole if a key packet has no whole-number time, one before the origin, or one that does
    not come after the packet before it. Without ``stretch`` one task orders a source; with it, a task orders so many
    line numbers of one (``operators/scans.py``), and the lines are read once, their key packets staged.
    """
    rows = parse_packets(lines).join(origins.select("source_id", "origin_pts"), "source_id", "left")
    checked = scans.neighbours(rows, F.col("pts"), "line_no", "prev", stretch=stretch).withColumn("bad", F.col("pts").isNull() | (F.col("pts") < F.coalesce("origin_pts", F.col("pts"))) | F.coalesce(F.col("pts") <= F.col("prev"), F.lit(False)))
    bad = checked.groupBy("source_id").agg(F.max("bad").alias("bad")).where("bad").select("source_id", F.lit(INVALID).alias("reject_code"))
    return (rows if stretch is None else checked).join(bad, "source_id", "left_anti").select("source_id", "line_no", "pts", "is_key"), bad
