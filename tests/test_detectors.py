"""Frames: thresholds at equality, ties, masks, single frames, and any number of partitions, against plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.functions import pixels
from frameloom.operators import anchor, changes, representatives, roi, segments, tiles
from frameloom.plans import flagship
from frameloom.settings import AnchorSettings, SpatialSettings

SETTINGS = SpatialSettings(pixel_delta=20, edge_delta=25, tile=3, cell_changed_fraction=0.5, changed_fraction=0.25, cell_fraction=0.25, overlay_missing_edges=1)
SCHEMA = "source_id string, ordinal int, pts long, width int, height int, px array<smallint>, excluded struct<x:int,y:int,width:int,height:int>"


def movie(seed: int, n: int, h: int = 7, w: int = 8, excluded=None, source: str = "a") -> list[tuple]:
    rnd = random.Random(seed)
    page = np.array([[rnd.choice([10, 240]) for _ in range(w)] for _ in range(h)])
    rows = []
    for k in range(n):
        if rnd.random() < 0.3:
            page = np.array([[rnd.choice([10, 240]) for _ in range(w)] for _ in range(h)])
        frame = page.copy()
        for _ in range(rnd.randrange(6)):
            frame[rnd.randrange(h), rnd.randrange(w)] = rnd.choice([0, 30, 120, 255])
        rows.append((source, k, 100 * k + rnd.randrange(50), w, h, frame.ravel().tolist(), excluded))
    return rows


def edge_flags(f):
    e = np.zeros(f.shape, bool)
    for y in range(f.shape[0]):
        for x in range(f.shape[1]):
            e[y, x] = (x > 0 and abs(f[y, x] - f[y, x - 1]) > 25) or (y > 0 and abs(f[y, x] - f[y - 1, x]) > 25)
    return e


def brute(rows: list[tuple], s: SpatialSettings):
    """Boundaries and representatives of one source by loops over pixels."""
    frames = [np.array(r[5]).reshape(r[4], r[3]) for r in rows]
    h, w = frames[0].shape
    ok = np.ones((h, w), bool)
    if rows[0][6]:
        x, y, a, b = rows[0][6]
        ok[y : y + b, x : x + a] = False
    cells = [(slice(y, y + s.tile), slice(x, x + s.tile)) for y in range(0, h, s.tile) for x in range(0, w, s.tile)]
    across = math.ceil(w / s.tile)
    starts = [0]
    for k in range(1, len(frames)):
        moved = (abs(frames[k] - frames[k - 1]) > s.pixel_delta) & ok
        shares = [moved[c].sum() / ok[c].sum() for c in cells if ok[c].any()]
        if moved.sum() / ok.sum() >= s.changed_fraction and sum(v >= s.cell_changed_fraction for v in shares) / len(shares) >= s.cell_fraction:
            starts.append(k)
    reps = []
    for a, b in zip(starts, [*starts[1:], len(frames)], strict=True):
        own = frames[a:b]
        top = np.max(own, axis=0)
        marks = [((top - f) > s.pixel_delta) & ok for f in own]
        edges = [edge_flags(f) & ok for f in own]
        supported = sum(m.astype(int) for m in marks) >= min(s.support_samples, b - a)
        core = sum(e.astype(int) for e in edges) >= max(1, math.ceil((b - a) * s.core_edge_fraction))
        keys = []
        for k, (m, e) in enumerate(zip(marks, edges, strict=True)):
            lost = core & ~e
            covered = {divmod(i, across) for i, c in enumerate(cells) if ok[c].any() and m[c].sum() / ok[c].sum() >= s.overlay_fraction and lost[c].sum() >= s.overlay_missing_edges}
            occluded = sum(any(t in covered for t in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1))) for y, x in covered)
            keys.append((-occluded, int((m & supported).sum()) - s.transient_penalty * int((m & ~supported).sum()), a + k))
        reps.append(max(keys)[2])
    return starts, reps


def run(spark, rows, settings=SETTINGS, chunk=256):
    frames = spark.createDataFrame(rows, SCHEMA)
    sources = frames.groupBy("source_id").agg(F.min("pts").alias("origin_pts"), (F.max("pts") - F.min("pts") + 100).alias("duration_ticks")).select("*", F.lit(1).cast("long").alias("tb_num"), F.lit(1000).cast("long").alias("tb_den"))
    samples = frames.join(sources, "source_id").select("source_id", "ordinal", "pts", (F.col("pts") - F.col("origin_pts")).alias("ticks"))
    return flagship.analyse(frames, sources, samples, settings)


@pytest.mark.parametrize("excluded", [None, (2, 1, 5, 4)])
def test_segments_and_representatives_equal_brute_force(spark, excluded):
    movies = {f"m{k}": movie(k, 9 + k, excluded=excluded, source=f"m{k}") for k in range(4)}
    found = run(spark, [r for rows in movies.values() for r in rows])
    got = {}
    for r in found.segments.orderBy("source_id", "segment_ix").collect():
        got.setdefault(r["source_id"], []).append((r["first_ordinal"], r["rep_ordinal"]))
    for name, rows in movies.items():
        starts, reps = brute(rows, SETTINGS)
        assert got[name] == list(zip(starts, reps, strict=True))


def test_chunks_do_not_change_the_choice(spark):
    rows = movie(5, 14)
    found = run(spark, rows)
    want = sorted(map(tuple, found.reps.collect()))
    for chunk in (1, 3):
        assert sorted(map(tuple, representatives.representatives(found.tiles, found.numbered, SETTINGS, chunk).collect())) == want


def test_one_frame_and_navigation(spark):
    found = run(spark, movie(1, 1))
    nav = found.navigation.collect()
    assert [(r["page"], r["start_ticks"], r["end_ticks"], r["reject_code"]) for r in nav] == [(1, 0, 100, None)]
    assert found.pairs.count() == 0 and found.boundaries.count() == 0


def test_pixel_delta_is_strict_and_fractions_are_not(spark):
    flat = [100] * 36
    moved = [121 if k < 9 else 120 for k in range(36)]  # 9 of 36 pixels by 21, the others by 20
    rows = [("a", 0, 0, 6, 6, flat, None), ("a", 1, 10, 6, 6, moved, None)]
    s = SpatialSettings(pixel_delta=20, tile=6, changed_fraction=0.25, cell_changed_fraction=0.25, cell_fraction=1.0)
    pair = run(spark, rows, s).pairs.first()
    assert (pair["changed"], pair["changed_fraction"], pair["cell_fraction"]) == (9, 0.25, 1.0)
    assert run(spark, rows, s).boundaries.count() == 1


def test_partial_tiles_and_binary_kernel_agree(spark):
    rows = movie(2, 3, h=5, w=7, excluded=(1, 1, 2, 2))
    frames = spark.createDataFrame(rows, SCHEMA)
    binary = frames.withColumn("gray", F.unhex(F.array_join(F.transform("px", lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), "")))
    a = sorted(map(repr, tiles.split_tiles(frames, 3, 25).collect()))
    assert a == sorted(map(repr, tiles.split_tiles_binary(binary, 3, 25).collect())) and len(a) == 3 * 2 * 3


def test_crop_outside_is_rejected(spark):
    frames = spark.createDataFrame([("a", 0, 0, 4, 3, list(range(12)), None)], SCHEMA).drop("excluded")
    cut = lambda *r: tiles.crop(frames.withColumn("roi", F.struct(*(F.lit(v).alias(n) for v, n in zip(r, ("x", "y", "width", "height"), strict=True))))).first()
    assert cut(1, 1, 2, 2)["px"] == [5, 6, 9, 10]
    assert cut(3, 0, 2, 1)["reject_code"] == "InvalidRegion" and cut(3, 0, 2, 1)["px"] is None


def test_automatic_roi_warnings(spark):
    black = [("b", 0, 0, 8, 8, [0] * 64, None)]
    stripe = [("s", 0, 0, 8, 8, [200 if 2 <= k // 8 <= 4 else 8 for k in range(64)], None)]
    framed = [("f", k, k, 8, 8, [0 if i % 8 in (0, 7) else 9 for i in range(64)], None) for k in range(2)]
    got = {r["source_id"]: tuple(r)[1:] for r in roi.automatic_roi(spark.createDataFrame(black + stripe + framed, SCHEMA)).collect()}
    assert got == {"b": (0, 0, 8, 8, "black_intro"), "s": (0, 0, 8, 8, "implausible_roi"), "f": (1, 0, 6, 8, None)}


def test_local_changes_take_the_first_of_equal_tiles_and_border_tiles(spark):
    assert sorted(spark.range(1).select(changes.origins(F.lit(9), 4, 2)).first()[0]) == [0, 2, 4, 5]
    assert spark.range(1).select(changes.origins(F.lit(3), 4, 2)).first()[0] == [0]
    a, b = [0] * 64, [0] * 64
    b[0], b[63] = 200, 200
    row = spark.createDataFrame([("a", 1, 8, 8, a, b, [True] * 64)], "source_id string, ordinal int, width int, height int, px array<smallint>, other array<smallint>, ok array<boolean>")
    got = changes.local_changes(row, AnchorSettings(tile=4, stride=2)).first()
    assert (got["tile_x"], got["tile_y"], got["max_sum"], got["max_count"], got["eligible"], got["changed"]) == (0, 0, 200, 16, 9, 2)
    masked = changes.local_changes(row.withColumn("ok", F.transform("ok", lambda x: F.lit(False))), AnchorSettings(tile=4, stride=2)).first()
    assert (masked["tile_x"], masked["max_count"], masked["eligible"]) == (0, 0, 0)


def brute_anchor(frames: list[np.ndarray], times: list[int], s: AnchorSettings) -> list[tuple]:
    hit = lambda a, b: anchor.compare(a, b, np.ones(a.shape, bool), s).hit(s)
    groups, a, start, stable, suppressed, n = [], 0, 0, 0, None, len(frames)
    for i in range(1, n):
        if hit(frames[a], frames[i]):
            if i == n - 1:
                commit = s.keep_unconfirmed and (suppressed is None or hit(frames[suppressed], frames[i]))
            else:
                commit = 2 * (times[i + 1] - times[i]) <= 3 * (times[i] - times[i - 1]) and hit(frames[a], frames[i + 1]) and not hit(frames[i], frames[i + 1])
            if commit:
                groups.append((start, i - 1, max(start, stable)))
                a = start = stable = i
                suppressed = suppressed if i == n - 1 else None
            elif i < n - 1:
                suppressed = i
        elif not hit(frames[i - 1], frames[i]):
            stable, suppressed = i, None
    return [*groups, (start, n - 1, max(start, stable))]


def test_anchor_fold_equals_loops_for_any_partitions(spark):
    s = AnchorSettings(mad=0.1, tile_mad=0.2, pixel_delta=20, changed_fraction=0.1, tile=4, stride=2)
    rows = [r for k in range(5) for r in movie(20 + k, 12 + k, source=f"m{k}")]
    frames = spark.createDataFrame(rows, SCHEMA).select("source_id", "ordinal", F.col("pts").alias("ticks"), "width", "height", "px")
    want = {}
    for name in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == name]
        want[name] = brute_anchor([np.array(r[5]).reshape(r[4], r[3]) for r in own], [r[2] for r in own], s)
    for parts in (1, 4, 37):
        got = {}
        for r in anchor.anchor_groups(frames.repartition(parts), s).orderBy("source_id", "group_ix").collect():
            got.setdefault(r["source_id"], []).append((r["first_ordinal"], r["last_ordinal"], r["rep_ordinal"]))
        assert got == want


def test_sql_functions(spark):
    pixels.register(spark)
    row = spark.sql("SELECT px_changed(array(1S, 50S), array(1S, 90S), 39), px_edges(array(0S, 99S, 0S, 0S), 2, 50)").first()
    assert row[0] == [False, True] and row[1] == [False, True, False, True]


def test_role_segments_number_from_zero(spark):
    rows = spark.createDataFrame([("a", k, r) for k, r in enumerate("xxyyx")], "source_id string, ordinal int, role string")
    flags = rows.withColumn("is_boundary", F.col("ordinal").isin(2, 4))
    assert [r["segment_ix"] for r in segments.segment_numbers(rows, flags).orderBy("ordinal").collect()] == [0, 0, 1, 1, 2]


def test_kernels_equal_the_jvm_forms(spark):
    """Masked and unmasked frames, sizes that leave partial tiles, ties between tiles, tiles without a pixel in sight."""
    import random

    rnd = random.Random(17)
    rows = []
    for source, (h, w) in (("a", (7, 9)), ("b", (4, 4)), ("c", (1, 5))):
        for k in range(6):
            rows.append((source, k, w, h, [rnd.choice([0, 0, 90, 200]) for _ in range(h * w)], None if source == "b" else (0, 0, 4, 4)))
    frames = spark.createDataFrame(rows, "source_id string, ordinal int, width int, height int, px array<smallint>, excluded struct<x int, y int, width int, height int>")
    cut = tiles.split_tiles(frames, 3, 25)
    assert sorted(map(repr, changes.tile_changes(cut, 60).collect())) == sorted(map(repr, changes.tile_changes_in_jvm(cut, 60).collect()))
    whole = frames.select("source_id", "ordinal", "width", "height", "px", tiles.valid_array(F.col("width"), F.col("height"), F.col("excluded")).alias("ok"))
    other = whole.select("source_id", (F.col("ordinal") + 1).alias("ordinal"), F.col("px").alias("other"))
    pairs = whole.join(other, ["source_id", "ordinal"])
    for tile, stride in ((3, 2), (20, 10), (2, 1)):
        anchor_settings = AnchorSettings(tile=tile, stride=stride)
        assert sorted(map(repr, changes.local_changes(pairs, anchor_settings).collect())) == sorted(map(repr, changes.local_changes_in_jvm(pairs, anchor_settings).collect()))


def test_packed_tiles_give_the_same_analysis(spark):
    """Frames as one binary value each, against the same frames as arrays: pairs, representatives and diagnostics."""
    rows = movie(5, 30) + movie(6, 9, excluded=(1, 1, 3, 3), source="b")
    frames = spark.createDataFrame(rows, SCHEMA)
    samples = frames.select("source_id", "ordinal", F.col("pts").alias("ticks"))
    sources = samples.groupBy("source_id").agg((F.max("ticks") + 5).alias("duration_ticks"), F.lit(1).cast("long").alias("tb_num"), F.lit(1000).cast("long").alias("tb_den"))
    gray = spark.createDataFrame([(r[0], r[1], r[3], r[4], bytes(r[5]), r[6]) for r in rows], "source_id string, ordinal int, width int, height int, gray binary, excluded struct<x:int,y:int,width:int,height:int>")
    a, b = (flagship.analyse(f, sources, samples, SETTINGS) for f in (frames.drop("pts"), gray))
    assert dict(b.tiles.dtypes)["px"] == "binary"
    for part in ("pairs", "reps", "bounds"):
        assert sorted(map(repr, getattr(a, part).collect())) == sorted(map(repr, getattr(b, part).collect()))
