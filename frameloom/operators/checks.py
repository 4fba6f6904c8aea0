"""Order, continuity and reference checks; each returns the rows that break the rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scans

VIOLATION = ["source_id", "rule", "row_key", "detail"]


def violation(df: DataFrame, rule: str, row_key: Column, detail: Column) -> DataFrame:
    return df.select("source_id", F.lit(rule).alias("rule"), row_key.cast("string").alias("row_key"), detail.cast("string").alias("detail"))


def out_of_order(rows: DataFrame, value: str, order: str = "ordinal", stretch: int | None = None) -> DataFrame:
    """Rows whose value is not above that of the row before; adds prev_value. For ``stretch`` see ``scans``."""
    return scans.neighbours(rows, F.col(value), order, before="prev_value", stretch=stretch).where(F.col(value) <= F.col("prev_value"))


def broken_ordinals(rows: DataFrame, order: str, ordinal: str = "ordinal", stretch: int | None = None) -> DataFrame:
    """Rows whose ordinal is not their place in order, from 0; adds place."""
    return scans.ranks(rows, order, "place", stretch).withColumn("place", (F.col("place") - 1).cast("int")).where(F.col("place") != F.col(ordinal))


def drift(rows: DataFrame, value: str, order: str, unknown: Column, rejected: Column, stretch: int | None = None) -> DataFrame:
    """Rows whose known value differs from the last known one, or is rejected outright; adds last_known and code."""
    known = rows.withColumn("_known", F.when(~unknown, F.col(value)))
    told = scans.last_known(known, F.col("_known"), order, "last_known", stretch)
    code = F.when(rejected, "UnsupportedDisplayTransform").when(F.col("_known").isNotNull() & F.col("last_known").isNotNull() & (F.col("_known") != F.col("last_known")), "MetadataDrift")
    return told.withColumn("code", code).where("code IS NOT NULL").drop("_known")


def missing_references(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows whose non-null reference is not among the known keys of their source."""
    other = known.select(F.col("source_id").alias("_s"), F.col(known_key).alias("_k"))
    return rows.where(F.col(key).isNotNull()).join(other, (F.col("source_id") == F.col("_s")) & (F.col(key) == F.col("_k")), "left_anti")


def present_references(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    other = known.select(F.col("source_id").alias("_s"), F.col(known_key).alias("_k"))
    return rows.join(other, (F.col("source_id") == F.col("_s")) & (F.col(key) == F.col("_k")), "left_semi")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
