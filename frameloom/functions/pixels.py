"""Pixel arithmetic on arrays, inside the JVM; also registered as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def count_true(flags: Column) -> Column:
    return F.aggregate(flags, F.lit(0), lambda n, x: n + x.cast("int"))


def changed(current: Column, previous: Column, delta: int) -> Column:
    """Per pixel: whether it differs by more than ``delta``."""
    return F.zip_with(current, previous, lambda a, b: F.abs(a.cast("int") - b.cast("int")) > delta)


def both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x & y)


def brighter(a: Column, b: Column) -> Column:
    """Per pixel the larger value."""
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def edges(px: Column, width: Column, delta: int) -> Column:
    """Per pixel of a whole frame: whether it differs from the one to its left or above by more than ``delta``."""
    wide = lambda v: v.cast("int")
    return F.transform(
        px,
        lambda v, i: ((i % width > 0) & (F.abs(wide(v) - wide(F.get(px, i - 1))) > delta)) | ((i >= width) & (F.abs(wide(v) - wide(F.get(px, i - width))) > delta)),
    ).cast("array<boolean>")


def cut(px: Column, width: Column, y: Column, x: Column, h: Column, w: Column) -> Column:
    """The rectangle of h rows and w columns at (y, x) of a row-major frame."""
    rows = F.sequence(y, y + h - 1)
    return F.flatten(F.transform(rows, lambda r: F.slice(px, r * width + x + 1, w)))


def register(spark: SparkSession) -> None:
    """px_changed(a, b, delta) and px_edges(px, width, delta) for SQL."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION px_changed(a ARRAY<SMALLINT>, b ARRAY<SMALLINT>, delta INT) RETURNS ARRAY<BOOLEAN> "
        "RETURN zip_with(a, b, (x, y) -> abs(CAST(x AS INT) - CAST(y AS INT)) > delta)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION px_edges(px ARRAY<SMALLINT>, width INT, delta INT) RETURNS ARRAY<BOOLEAN> "
        "RETURN transform(px, (v, i) -> (i % width > 0 AND abs(CAST(v AS INT) - CAST(get(px, i - 1) AS INT)) > delta) "
        "OR (i >= width AND abs(CAST(v AS INT) - CAST(get(px, i - width) AS INT)) > delta))"
    )
