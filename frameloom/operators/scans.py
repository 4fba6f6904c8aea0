"""Running counts, neighbours and last known values of one long source over many tasks.

A source's line is cut into stretches of its (whole-number) order, each ordered by a task of its own; of every stretch one row (a sum, its last
row, its last known value) is scanned over the source's stretches and carried into the next ones. Without a stretch a source is ordered by one task. Results are
the same; rows of equal order fall into one stretch. Rows are staged once (they are read twice) and exchanged once, by (source, stretch).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.staging import staged

_STRETCH = "_stretch"


def _cut(rows: DataFrame, order: str, stretch: int) -> DataFrame:
    low = F.call_function("div", F.col(order).cast("long") - F.pmod(F.col(order).cast("long"), F.lit(stretch)), F.lit(stretch).cast("long"))
    return staged(rows.withColumn(_STRETCH, F.coalesce(low, F.lit(-1 << 62))))  # rows without an order come first, as in a sort


def _carried(rows: DataFrame, found: DataFrame, over: dict[str, Column]) -> DataFrame:
    """``rows`` with what is carried into their stretch: ``over`` looks along a source's stretches, one row each."""
    return rows.join(found.select("source_id", _STRETCH, *(c.alias(n) for n, c in over.items())), ["source_id", _STRETCH], "left")


def _along() -> Window:
    return Window.partitionBy("source_id").orderBy(_STRETCH)


def running_count(rows: DataFrame, counted: Column, order: str, name: str, stretch: int | None = None) -> DataFrame:
    """``rows`` with the number of rows up to each one, itself included, where ``counted`` holds."""
    one = F.coalesce(counted, F.lit(False)).cast("long")
    upto = (Window.unboundedPreceding, 0)
    if stretch is None:
        return rows.withColumn(name, F.sum(one).over(Window.partitionBy("source_id").orderBy(order).rowsBetween(*upto)))
    cut = _cut(rows, order, stretch)
    sums = cut.groupBy("source_id", _STRETCH).agg(F.sum(one).alias("_sum"))
    here = cut.withColumn(name, F.sum(one).over(Window.partitionBy("source_id", _STRETCH).orderBy(order).rowsBetween(*upto)))
    told = _carried(here, sums, {"_before": F.sum("_sum").over(_along().rowsBetween(Window.unboundedPreceding, -1))})
    return told.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop(_STRETCH, "_before")


def ranks(rows: DataFrame, order: str, name: str, stretch: int | None = None) -> DataFrame:
    """``rows`` with their place in their source, from 1."""
    if stretch is None:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy("source_id").orderBy(order)).cast("long"))
    return running_count(rows, F.lit(True), order, name, stretch)


def neighbours(rows: DataFrame, value: Column, order: str, before: str | None = None, after: str | None = None, stretch: int | None = None) -> DataFrame:
    """``rows`` with ``value`` of the row before (as column ``before``) and of the row after (``after``) in their source."""
    rows = rows.withColumn("_value", F.struct(value.alias("v")))  # a null value is still a row
    keys = ["source_id"] if stretch is None else ["source_id", _STRETCH]
    cut = rows if stretch is None else _cut(rows, order, stretch)
    own = Window.partitionBy(*keys).orderBy(order)
    told = cut.withColumns({"_before": F.lag("_value").over(own), "_after": F.lead("_value").over(own)})
    if stretch is not None:
        ends = cut.groupBy(*keys).agg(F.min_by("_value", order).alias("_first"), F.max_by("_value", order).alias("_last"))
        told = _carried(told, ends, {"_earlier": F.lag("_last").over(_along()), "_later": F.lead("_first").over(_along())})
        told = told.withColumns({"_before": F.coalesce("_before", "_earlier"), "_after": F.coalesce("_after", "_later")}).drop(_STRETCH, "_earlier", "_later")
    new = {n: F.col(f"{c}.v") for n, c in ((before, "_before"), (after, "_after")) if n is not None}
    return told.withColumns(new).drop("_value", "_before", "_after")


def last_known(rows: DataFrame, value: Column, order: str, name: str, stretch: int | None = None) -> DataFrame:
    """``rows`` with the last ``value`` that is not null among the rows before each one."""
    earlier = (Window.unboundedPreceding, -1)
    rows = rows.withColumn("_value", value)
    if stretch is None:
        return rows.withColumn(name, F.last("_value", ignorenulls=True).over(Window.partitionBy("source_id").orderBy(order).rowsBetween(*earlier))).drop("_value")
    cut = _cut(rows, order, stretch)
    lasts = cut.groupBy("source_id", _STRETCH).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_last"))
    here = cut.withColumn(name, F.last("_value", ignorenulls=True).over(Window.partitionBy("source_id", _STRETCH).orderBy(order).rowsBetween(*earlier)))
    told = _carried(here, lasts, {"_before": F.last("_last", ignorenulls=True).over(_along().rowsBetween(*earlier))})
    return told.withColumn(name, F.coalesce(name, "_before")).drop(_STRETCH, "_before", "_value")
