"""One long source over many tasks: the forms by stretches equal those by source."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from frameloom.operators import checks, policies, scans, segments


def rows_of(df, *names):
    return sorted((tuple(r) for r in df.select(*(names or df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def line(spark):
    rnd = random.Random(3)
    rows = []
    for source, n in (("a", 400), ("b", 1), ("c", 37)):
        at = 0
        for _ in range(n):
            at += rnd.choice([1, 1, 2, 90])  # whole stretches without a row
            rows.append((source, at, rnd.choice([None, 1, 2, 2, 3]), rnd.random() < 0.2))
    return spark.createDataFrame(rows, "source_id string, ordinal int, value int, hit boolean").repartition(3).cache()


@pytest.mark.parametrize("stretch", [1, 7, 64, 100_000])
def test_stretches_change_nothing(line, stretch):
    for make in (
        lambda s: scans.running_count(line, F.col("hit"), "ordinal", "n", s),
        lambda s: scans.ranks(line, "ordinal", "n", s),
        lambda s: scans.neighbours(line, F.col("value"), "ordinal", "left", "right", s),
        lambda s: scans.last_known(line, F.col("value"), "ordinal", "known", s),
        lambda s: checks.out_of_order(line, "value", stretch=s),
        lambda s: checks.broken_ordinals(line, "ordinal", stretch=s).drop("_stretch"),
        lambda s: checks.drift(line, "value", "ordinal", F.col("value") == 3, F.col("value") == 1, s),
        lambda s: segments.segment_numbers(line.drop("hit"), line.select("source_id", "ordinal", F.col("hit").alias("is_boundary")), stretch=s),
    ):
        assert rows_of(make(stretch)) == rows_of(make(None))


def test_negative_orders_fall_into_stretches_in_order(spark):
    rows = spark.createDataFrame([("a", k, k) for k in range(-9, 9)], "source_id string, ordinal long, value int")
    assert [r["n"] for r in scans.ranks(rows, "ordinal", "n", 4).orderBy("ordinal").collect()] == list(range(1, 19))


def test_gaps_and_navigation_by_stretches(spark, line):
    packets = line.select("source_id", F.col("ordinal").cast("long").alias("ticks"))
    sources = packets.groupBy("source_id").agg((F.max("ticks") + 5).alias("duration_ticks")).select("*", F.lit(1).cast("long").alias("tb_num"), F.lit(10).cast("long").alias("tb_den"))
    assert rows_of(policies.time_gaps(packets, sources, 50)) == rows_of(policies.time_gaps(packets, sources))
    assert rows_of(policies.gap_policy(packets, sources, 60, 50)) == rows_of(policies.gap_policy(packets, sources, 60))
    pages = packets.withColumn("page_id", F.concat("source_id", F.col("ticks").cast("string")))
    assert rows_of(segments.navigation(pages, sources, 50)) == rows_of(segments.navigation(pages, sources))


def test_no_task_orders_a_whole_source(spark):
    rows = spark.range(20_000).select(F.lit("a").alias("source_id"), F.col("id").cast("int").alias("ordinal"), (F.col("id") % 9 == 0).alias("hit"))
    told = scans.running_count(rows, F.col("hit"), "ordinal", "n", 500)
    assert told.agg(F.max("n")).first()[0] == 2223
    # The rows' own window is keyed by the stretch; only the scan over one row a stretch is keyed by the source alone.
    windows = [x for x in told._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
    rows_own = [w for w in windows if "ordinal#" in w]
    assert len(windows) == 2 and len(rows_own) == 1 and "_stretch#" in rows_own[0].split("ordinal#")[0]
