"""Joins of samples, segments, packets and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sample_times(rows: DataFrame, samples: DataFrame, key: str = "rep_ordinal") -> DataFrame:
    """Rows with the ticks and pts of the sample they refer to."""
    return rows.join(samples.select("source_id", F.col("ordinal").alias(key), "ticks", "pts"), ["source_id", key])


def _neighbours(both: DataFrame, at: str, found: str, stretch: int | None) -> DataFrame:
    """``both`` with _before and _after: the last non-null ``found`` up to a row, and the first from it on, in the order of (at, _kind).

    Without ``stretch`` one task orders a source. With it, each source's time line is cut every so many ticks and a task
    orders one stretch; of every stretch one row, its first and last find, is carried over to the others.
    """
    span = lambda w, low, high: w.rowsBetween(low, high)
    start, end = Window.unboundedPreceding, Window.unboundedFollowing
    keys = ["source_id"] if stretch is None else ["source_id", "_stretch"]
    if stretch is not None:
        low = F.call_function("div", F.col(at) - F.pmod(F.col(at), F.lit(stretch)), F.lit(stretch))
        both = both.withColumn("_stretch", F.coalesce(low, F.lit(-1 << 62)))  # rows without a time come first, as in the order
    order = Window.partitionBy(*keys).orderBy(at, "_kind")
    here = both.withColumn("_before", F.last(found, ignorenulls=True).over(span(order, start, 0))).withColumn("_after", F.first(found, ignorenulls=True).over(span(order, 0, end)))
    if stretch is None:
        return here
    there = F.when(F.col(found).isNotNull(), F.col(at))
    ends = both.groupBy(*keys).agg(F.min_by(found, there).alias("_first"), F.max_by(found, there).alias("_last"))
    along = Window.partitionBy("source_id").orderBy("_stretch")
    ends = ends.select(*keys, F.last("_last", ignorenulls=True).over(span(along, start, -1)).alias("_earlier"), F.first("_first", ignorenulls=True).over(span(along, 1, end)).alias("_later"))
    joined = here.join(ends, keys, "left").withColumns({"_before": F.coalesce("_before", "_earlier"), "_after": F.coalesce("_after", "_later")})
    return joined.drop("_stretch", "_earlier", "_later")


def covering_segment(requests: DataFrame, segments: DataFrame, stretch: int | None = None) -> DataFrame:
    """Requests (ticks) with segment_ix of the half-open segment that covers them, else null.

    Segments tile the time line, so this is the last start at or before the request: a union and a window
    over each source, or over ``stretch`` ticks of it for long sources, never a range join.
    """
    starts = segments.select("source_id", F.col("start_ticks").alias("ticks"), F.lit(0).alias("_kind"), F.struct("segment_ix", "end_ticks").alias("_found"), F.lit(None).cast(requests.drop("source_id", "ticks").schema.simpleString()).alias("_row"))
    asks = requests.select("source_id", "ticks", F.lit(1).alias("_kind"), F.lit(None).cast(starts.schema["_found"].dataType).alias("_found"), F.struct(*(c for c in requests.columns if c not in ("source_id", "ticks"))).alias("_row"))
    told = _neighbours(starts.unionByName(asks), "ticks", "_found", stretch).where("_kind = 1")
    return told.select("source_id", "ticks", "_row.*", F.when(F.col("ticks") < F.col("_before.end_ticks"), F.col("_before.segment_ix")).alias("segment_ix"))


def nearest_sample(requests: DataFrame, samples: DataFrame, stretch: int | None = None) -> DataFrame:
    """Requests (at_num / at_den ticks) with the ordinal and ticks of the nearest sample; a tie goes to the earlier one.

    Requests are rationals, so distances are compared as whole numbers after cross-multiplication. As samples sort by
    whole ticks, a request takes its place by the floor of its time. ``stretch`` is that of ``covering_segment``.
    """
    payload = [c for c in requests.columns if c != "source_id"]
    kind = requests.select(F.struct(*payload).alias("r")).schema["r"].dataType
    floor = F.call_function("div", F.col("at_num") - F.pmod("at_num", "at_den"), F.col("at_den"))
    asks = requests.select("source_id", floor.alias("_t"), F.lit(1).alias("_kind"), F.struct(*payload).alias("_row"), F.lit(None).cast("struct<ordinal:int,ticks:bigint>").alias("_s"))
    points = samples.select("source_id", F.col("ticks").alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(kind).alias("_row"), F.struct(F.col("ordinal").cast("int").alias("ordinal"), F.col("ticks").cast("long").alias("ticks")).alias("_s"))
    both = _neighbours(asks.unionByName(points), "_t", "_s", stretch)
    told = both.where("_kind = 1").select("source_id", "_row.*", "_before", "_after")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    to_before = wide("at_num") - wide("_before.ticks") * wide("at_den")
    to_after = wide("_after.ticks") * wide("at_den") - wide("at_num")
    pick = F.when(F.col("_after").isNull() | (F.col("_before").isNotNull() & (to_before <= to_after)), F.col("_before")).otherwise(F.col("_after"))
    return told.withColumn("_pick", pick).select("source_id", *payload, F.col("_pick.ordinal").alias("ordinal"), F.col("_pick.ticks").alias("ticks")).where("ordinal IS NOT NULL")


def reconcile(index: DataFrame, decoded: DataFrame) -> DataFrame:
    """The full packet index with decoded rows: (source_id, ordinal, pts, decoded, reject_code).

    ``decoded`` (source_id, pts) should hold exactly the even places of the index; a decoded time that is not there, and
    an even place that was not decoded, are rejected, odd places become placeholders.
    """
    placed = index.withColumn("ordinal", (F.row_number().over(Window.partitionBy("source_id").orderBy("pts")) - 1).cast("int"))
    full = placed.join(decoded.select("source_id", "pts", F.lit(True).alias("decoded")), ["source_id", "pts"], "full").withColumn("decoded", F.coalesce("decoded", F.lit(False)))
    bad = F.col("ordinal").isNull() | ((F.col("ordinal") % 2 == 0) != F.col("decoded"))
    return full.select("source_id", "ordinal", "pts", "decoded", F.when(bad, F.lit("DecodeFailed")).alias("reject_code"))


def exact_frames(requests: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (source_id, pts) with their frames, and the requests without one: never a neighbour instead."""
    return requests.join(frames, ["source_id", "pts"]), requests.join(frames.select("source_id", "pts"), ["source_id", "pts"], "left_anti")


def drifted(registry: DataFrame, listing: DataFrame, columns: list[str], key: str = "path") -> DataFrame:
    """Registered rows whose file is missing or differs in any column, null-safely: (key, change)."""
    new = listing.select(key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_there"))
    joined = registry.join(new, key, "full")
    changed = [F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in columns]
    known = F.col(columns[0]).isNotNull() | F.col("_there").isNull()
    what = F.when(F.col("_there").isNull(), F.lit("missing")).when(~known, F.lit("unregistered")).otherwise(F.array_join(F.filter(F.array(*changed), lambda x: x.isNotNull()), ","))
    return joined.select(key, what.alias("change")).where("change <> ''")
