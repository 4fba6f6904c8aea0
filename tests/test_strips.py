"""Frames of real size as strips, against the plan over single tiles and plain loops."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from frameloom.operators import representatives, strips
from frameloom.plans import flagship

from .test_detectors import SETTINGS, brute, movie

GRAY = "source_id string, ordinal int, width int, height int, gray binary, excluded struct<x:int,y:int,width:int,height:int>"


def tables(spark, rows, gaps=1):
    gray = spark.createDataFrame([(r[0], gaps * r[1], r[3], r[4], bytes(r[5]), r[6]) for r in rows], GRAY).repartition(3)
    samples = spark.createDataFrame([(r[0], gaps * r[1], r[2]) for r in rows], "source_id string, ordinal int, ticks long")
    sources = samples.groupBy("source_id").agg((F.max("ticks") + 5).alias("duration_ticks"), F.lit(1).cast("long").alias("tb_num"), F.lit(1000).cast("long").alias("tb_den"))
    return gray, sources, samples


def still(n: int, seed: int, source: str):
    """One segment throughout: frames that differ in a few pixels."""
    first = movie(seed, 1, source=source)[0]
    rows = []
    for k in range(n):
        px = list(first[5])
        px[k % len(px)] = (px[k % len(px)] + 7 * k) % 256
        rows.append((*first[:1], k, 10 * k, *first[3:5], px, first[6]))
    return rows


@pytest.mark.parametrize("chunk", [1, 4, 256])
def test_strips_equal_tiles_and_loops(spark, chunk):
    """Segments inside a chunk, across two and across many; with a mask and without; ordinals with gaps."""
    movies = {"a": movie(5, 30, source="a"), "b": movie(6, 9, excluded=(1, 1, 3, 3), source="b"), "c": still(23, 2, "c"), "d": movie(1, 1, source="d")}
    rows = [r for m in movies.values() for r in m]
    for gaps in (1, 2):
        gray, sources, samples = tables(spark, rows, gaps)
        found = flagship.analyse(gray, sources, samples, SETTINGS, chunk)
        pixels = gray.select("source_id", "ordinal", "width", "height", F.expr("transform(sequence(1, octet_length(gray)), i -> cast(conv(hex(substring(gray, i, 1)), 16, 10) as smallint))").alias("px"), "excluded")
        want = flagship.analyse(pixels, sources, samples, SETTINGS)
        for part in ("pairs", "reps", "bounds", "navigation"):
            assert sorted(map(repr, getattr(found, part).collect())) == sorted(map(repr, getattr(want, part).collect())), part
        got: dict = {}
        for r in found.segments.orderBy("source_id", "segment_ix").collect():
            got.setdefault(r["source_id"], []).append((r["first_ordinal"] // gaps, r["rep_ordinal"] // gaps))
        for name in ("a", "b", "c"):
            starts, reps = brute(movies[name], SETTINGS)
            assert got[name] == list(zip(starts, reps, strict=True))


def test_pixels_are_exchanged_once(spark):
    """With broadcasts off, after the strips have been staged no exchange carries frames: neither the changes nor the scores."""
    gray, sources, samples = tables(spark, movie(5, 30))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        own = strips.cut_strips(gray, SETTINGS.tile, SETTINGS.edge_delta, 8)
        changes = strips.strip_changes(own, SETTINGS.pixel_delta)
        numbered = samples.withColumn("segment_ix", F.lit(0))
        scores = representatives.frame_scores(strips.strip_scores(strips.with_segments(own, numbered, 8), SETTINGS))
        for df in (changes, scores):
            plan = df._jdf.queryExecution().executedPlan()
            exchanged = [x for x in plan.toString().splitlines() if "Exchange" in x]
            assert exchanged
            nodes, held = [plan], []
            while nodes:
                node = nodes.pop()
                nodes += [node.children().apply(k) for k in range(node.children().size())]
                if node.nodeName() == "Exchange":
                    held.append(node.output().toString())
            assert held and not any("parts#" in h for h in held), held
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_segment_of_very_many_frames(spark):
    """100,000 frames of one segment: chunks leave a vector each, and a group holds one."""
    frames = spark.range(100_000).select(
        F.lit("a").alias("source_id"), F.col("id").cast("int").alias("ordinal"), F.lit(2).alias("width"), F.lit(2).alias("height"),
        F.unhex(F.concat(F.lit("10"), F.when(F.col("id") == 77_777, "ff").otherwise("10"), F.lit("1010"))).alias("gray"),
    )
    own = strips.cut_strips(frames, SETTINGS.tile, SETTINGS.edge_delta)
    told = strips.with_segments(own, frames.select("source_id", "ordinal", F.lit(0).alias("segment_ix")))
    tops = strips.merged_tops(told)
    assert tops.count() == 391 and {(bytes(r["top"]), r["n_frames"]) for r in tops.collect()} == {(bytes([16, 255, 16, 16]), 100_000)}
    scores = strips.strip_scores(told, SETTINGS)
    assert scores.count() == 100_000
    assert scores.where("marked > 0").count() == 99_999  # all but the bright one differ from the top
