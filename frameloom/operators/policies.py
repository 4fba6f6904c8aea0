"""Sampling policies from key packets: gaps, choice, and the rows that are observed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scans


def time_gaps(packets: DataFrame, sources: DataFrame, stretch: int | None = None) -> DataFrame:
    """(source_id, ticks, gap, tail): the gap before each time (the first: since 0), and to the duration after the last; for ``stretch`` see ``scans``."""
    rows = scans.neighbours(packets, F.col("ticks"), "ticks", "before", "after", stretch).withColumn("gap", F.col("ticks") - F.coalesce("before", F.lit(0).cast("long")))
    return rows.join(sources.select("source_id", "duration_ticks"), "source_id").select("source_id", "ticks", "gap", F.when(F.col("after").isNull(), F.col("duration_ticks") - F.col("ticks")).alias("tail"))


def gap_policy(packets: DataFrame, sources: DataFrame, limit_ticks: int, stretch: int | None = None) -> DataFrame:
    """(source_id, n, max_gap, policy, reject_code): ``half`` if every gap, head and tail too, is below the limit.

    Times must begin at 0 or later, increase strictly and end before the duration.
    """
    by = time_gaps(packets, sources, stretch).groupBy("source_id").agg(
        F.count("*").alias("n"), F.max(F.greatest("gap", F.coalesce("tail", F.col("gap")))).alias("max_gap"), F.min("ticks").alias("first"), F.max("tail").alias("tail"), F.sum((F.col("gap") <= 0).cast("int")).alias("flat"), F.min("gap").alias("least")
    )
    # Only the first gap may be 0 (a first time of 0).
    bad = (F.col("first") < 0) | (F.col("tail") <= 0) | (F.col("flat") > F.when(F.col("first") == 0, 1).otherwise(0))
    return by.select("source_id", "n", "max_gap", F.when(~bad, F.when(F.col("max_gap") < limit_ticks, "half").otherwise("all")).alias("policy"), F.when(bad, F.lit("InvalidTiming")).alias("reject_code"))


def select_observations(samples: DataFrame, policy: Column) -> DataFrame:
    """Policy all observes every sample, half the even ordinals."""
    return samples.withColumn("is_observation", (policy == "all") | (F.col("ordinal") % 2 == 0))


def resolve_policy(sources: DataFrame, gaps: DataFrame) -> DataFrame:
    """(source_id, policy, backend) of sources (codec, requested: auto, all or half; native: whether a native reader is there).

    Automatic choice looks at the gaps of H.264 sources only; half needs the native reader, all else falls back to all.
    """
    joined = sources.join(gaps.select("source_id", F.col("policy").alias("by_gaps")), "source_id", "left")
    wanted = F.when(F.col("requested") != "auto", F.col("requested")).when(F.col("codec") == "h264", F.coalesce("by_gaps", F.lit("all"))).otherwise("all")
    policy = F.when((wanted == "half") & F.col("native"), "half").otherwise("all")
    return joined.select("source_id", policy.alias("policy"), F.when(policy == "half", "native").otherwise("software").alias("backend"))
