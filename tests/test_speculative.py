"""The anchor detector over pieces of long sources equals the fold over whole ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from frameloom.operators import anchor
from frameloom.settings import AnchorSettings

SETTINGS = AnchorSettings(mad=0.05, tile_mad=0.1, pixel_delta=20, changed_fraction=0.05, tile=4, stride=2)
SCHEMA = "source_id string, ordinal int, ticks long, width int, height int, px array<smallint>"


def source(name: str, seed: int, n: int, change: float, gap: int | None = None) -> list[tuple]:
    rnd, rows, ticks = random.Random(seed), [], 0
    page = [rnd.choice([20, 220]) for _ in range(36)]
    for k in range(n):
        if rnd.random() < change:
            page = [rnd.choice([20, 220]) for _ in range(36)]
        px = list(page)
        if rnd.random() < 0.15:  # a flash, or a slow fade
            px = [rnd.choice([20, 220, v]) for v in px]
        ticks += rnd.choice([10, 10, 11, 40])
        rows.append((name, k + (50 if gap is not None and k >= gap else 0), ticks, 6, 6, px))
    return rows


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("piece", [1, 6, 15, 1000])
def test_pieces_equal_the_whole(spark, piece):
    rows = source("busy", 1, 120, 0.3) + source("calm", 2, 90, 0.05) + source("still", 3, 60, 0.0) + source("one", 4, 1, 0.5) + source("gap", 5, 40, 0.3, gap=20)
    frames = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain(anchor.anchor_groups(frames, SETTINGS))
    assert plain(anchor.speculative_groups(frames, SETTINGS, piece)) == want
    assert len(want) > 30


def test_most_pieces_of_a_busy_source_are_stitched(spark, monkeypatch):
    """A source with changes in each piece is not folded in one go: what is left for that has no frames of it."""
    frames = spark.createDataFrame(source("busy", 7, 400, 0.3) + source("still", 3, 60, 0.0), SCHEMA)
    whole, seen = anchor.anchor_groups, []

    def counted(rest, settings):
        seen.append({r["source_id"] for r in rest.select("source_id").distinct().collect()})
        return whole(rest, settings)

    want = plain(whole(frames, SETTINGS))
    monkeypatch.setattr(anchor, "anchor_groups", counted)
    assert plain(anchor.speculative_groups(frames, SETTINGS, 40)) == want
    assert seen == [{"still"}]


def test_masks_go_along(spark):
    frames = spark.createDataFrame(source("busy", 9, 60, 0.3), SCHEMA).withColumn("ok", F.transform(F.sequence(F.lit(0), F.lit(35)), lambda i: i % 6 >= 3))
    assert plain(anchor.speculative_groups(frames, SETTINGS, 20)) == plain(anchor.anchor_groups(frames, SETTINGS))
