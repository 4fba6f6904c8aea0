"""Live operators: typed state that outlives code, masks, timers, and pages in an ordered index."""

from __future__ import annotations

import random
import tempfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.functions.edit_fold import PageIndex, apply_edit
from frameloom.operators import anchor, changes, pages
from frameloom.settings import AnchorSettings, SpatialSettings
from frameloom.streaming import live, progress, runs

SETTINGS = AnchorSettings(mad=0.05, tile_mad=0.1, pixel_delta=20, changed_fraction=0.05, tile=4, stride=2)
FRAMES = "source_id string, ordinal int, pts long, width int, height int, px array<smallint>, is_end boolean, excluded struct<x int, y int, width int, height int>"


def masked_frames(seed: int, n: int):
    """Source m changes inside its mask only, source p in sight, source q both."""
    rnd, rows = random.Random(seed), []
    for source in "mpq":
        base = [100] * 64
        for k in range(n):
            px = list(base)
            if source in "mq" and k >= 4:
                for y in range(2, 6):
                    for x in range(2, 6):
                        px[8 * y + x] = 250
            if source in "pq" and k >= n // 2:
                px[:16] = [rnd.choice([220, 221]) for _ in range(16)]
            rows.append((source, k, 7 * k, 8, 8, px, False, {"x": 2, "y": 2, "width": 4, "height": 4} if source != "p" else None))
        rows.append((source, n, 7 * n, 8, 8, None, True, None))
    return rows


def test_masks_count_in_the_live_anchor_detector(spark):
    frames = spark.createDataFrame(masked_frames(1, 16), FRAMES)
    got = runs.run_in_turns(frames, ["ordinal < 5", "ordinal BETWEEN 5 AND 10", "ordinal > 10"], lambda stream: live.live_anchor_groups(stream, SETTINGS)).where("row = 'group'")
    seen = frames.where("NOT is_end").withColumn("ticks", F.col("pts"))
    ok = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ~F.coalesce((i % 8 >= F.col("excluded.x")) & (i % 8 < F.col("excluded.x") + F.col("excluded.width")) & (F.floor(i / 8) >= F.col("excluded.y")) & (F.floor(i / 8) < F.col("excluded.y") + F.col("excluded.height")), F.lit(False)))
    want = anchor.anchor_groups(seen.withColumn("ok", ok), SETTINGS)
    names = want.columns
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert want.where("source_id = 'm'").count() == 1 and want.where("source_id = 'q'").count() == 2
    bare = anchor.anchor_groups(seen, SETTINGS)
    assert bare.where("source_id = 'm'").count() != 1 or bare.where("source_id = 'q'").count() != 2  # the mask matters in these frames


def test_a_whole_frame_pair_equals_the_tile_kernels(spark):
    rnd = random.Random(5)
    settings = SpatialSettings(pixel_delta=20, tile=3, changed_fraction=0.2, cell_changed_fraction=0.3, cell_fraction=0.4)
    hits = set()
    for _ in range(200):
        h, w = rnd.randint(1, 7), rnd.randint(1, 7)
        a, b = (np.array([[rnd.choice([0, 20, 21, 90]) for _ in range(w)] for _ in range(h)], np.int16) for _ in range(2))
        ok = np.array([[rnd.random() < 0.7 for _ in range(w)] for _ in range(h)])
        moved = (abs(a - b) > 20) & ok
        cells = [(moved[y : y + 3, x : x + 3].sum(), ok[y : y + 3, x : x + 3].sum()) for y in range(0, h, 3) for x in range(0, w, 3)]
        shares = [m / n for m, n in cells if n]
        want = bool(shares) and moved.sum() / ok.sum() >= 0.2 and sum(s >= 0.3 for s in shares) / len(shares) >= 0.4
        assert changes.is_boundary(a, b, ok, settings) == want
        hits.add(want)
    assert hits == {True, False}


class Older(live.GapPolicies):
    """The processor before ``n`` was added to its state."""

    SCHEMA = "pts long, gap long, ended boolean"

    def init(self, handle) -> None:
        own = handle.getValueState("gap", self.SCHEMA)

        class Narrow:
            def get(self):
                kept = own.get()
                return (kept[0], kept[1], 0, kept[2]) if kept else None

            def update(self, value):
                own.update((value[0], value[1], value[3]))

        self.state = Narrow()


class Newer(live.GapPolicies):
    """As registered now, but a count that an older checkpoint does not have starts at 100."""

    def init(self, handle) -> None:
        own = handle.getValueState("gap", live.POLICY_STATE)

        class Filled:
            def get(self):
                kept = own.get()
                return (kept[0], kept[1], 100 if kept[2] is None else kept[2], kept[3]) if kept else None

            def update(self, value):
                own.update(value)

        self.state = Filled()


def test_a_checkpoint_outlives_an_added_field(spark):
    rows = spark.createDataFrame([("a", 5, False, 0), ("a", 9, False, 0), ("b", 1, False, 0), ("a", 30, False, 1), ("a", 40, True, 1), ("b", 2, True, 1)], "source_id string, pts long, is_end boolean, turn int")
    path = tempfile.mkdtemp(prefix="spark-")
    with live.rocksdb(spark):
        for turn, processor in enumerate((Older(100), Newer(100))):
            rows.where(f"turn = {turn}").write.mode("append").parquet(f"{path}/in")
            stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
            out = stream.groupBy("source_id").transformWithStateInPandas(processor, live.POLICIES, "append", "none")
            out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{path}/out").select("source_id", "n", "max_gap", "policy").collect()
    assert sorted(map(tuple, got)) == [("a", 101, 21, "half"), ("b", 100, 1, "half")]
    assert spark.conf.get("spark.sql.streaming.stateStore.encodingFormat") == "unsaferow"


def test_states_set_no_disk_aside(spark):
    name = "spark.sql.streaming.stateStore.rocksdb.allowFAllocate"
    before = spark.conf.get(name, None)
    with live.rocksdb(spark, "unsaferow"):
        assert spark.conf.get(name) == "false"
    assert spark.conf.get(name, None) == before


def test_latest_progress_runs_on_as_an_aggregate_in_update_mode(spark):
    """A source's counter falls, rises, is null and comes in one turn only; the aggregate's state is not Avro."""
    rows = spark.createDataFrame([("a", 5, 0), ("a", 9, 1), ("a", 7, 2), ("b", 8, 0), ("b", 3, 2), ("c", None, 1), ("d", -4, 2), (None, 6, 0), (None, 2, 1)], "source_id string, counter long, turn int")
    got = runs.run_in_turns(rows, [f"turn = {k}" for k in range(3)], progress.latest, "update", "unsaferow")
    last = {r["source_id"]: r["counter"] for r in runs.latest_rows(got, ["source_id"]).collect()}
    assert last == {"a": 9, "b": 8, "c": None, "d": -4, None: 6}
    assert got.where("batch = 0").count() == 3 and spark.conf.get("spark.sql.streaming.stateStore.encodingFormat") == "unsaferow"


SECOND = 1_000_000
#: Spark takes rows at the epoch itself for late ones.
BASE = 1000


def watch_rows(spark, rows):
    """(source, second, counter, is_end, turn)"""
    frame = spark.createDataFrame(rows, "source_id string, second long, counter long, is_end boolean, turn int")
    return frame.select("source_id", F.timestamp_micros((F.col("second") + BASE) * SECOND).alias("ts"), "counter", "is_end", "turn")


def watched(spark, rows, turns):
    got = runs.run_in_turns(watch_rows(spark, rows), [f"turn = {k}" for k in range(turns)], lambda s: progress.watches(s, stall_us=10 * SECOND, total_us=60 * SECOND, delay="0 SECONDS"))
    return sorted((r["source_id"], r["run"], r["started"] // SECOND - BASE, r["progressed"] // SECOND - BASE, r["ended"] // SECOND - BASE, r["counter"], r["status"]) for r in got.collect() if r["source_id"] != "z")


def test_only_advances_put_off_a_stall_and_a_deadline_holds(spark):
    rows = [("r", t, 5, False, 0) for t in range(0, 30, 3)]  # one counter again and again
    rows += [("s", t, 50 - t, False, 0) for t in range(0, 30, 3)]  # falling counters
    rows += [("d", t, t, False, 0) for t in range(0, 100, 5)]  # advances without end: the deadline, then a second watch
    rows += [("e", 0, 1, False, 0), ("e", 10, 2, False, 0)]  # an advance at the very limit is too late
    rows += [("f", 0, 1, False, 0), ("f", 4, 1, True, 0), ("f", 8, 1, False, 0), ("f", 20, 3, True, 0)]
    rows += [("z", 10_000, 0, False, 1)]
    assert watched(spark, rows, 2) == [
        ("d", 1, 0, 55, 60, 55, "deadline"), ("d", 2, 60, 95, 105, 95, "stall"),
        ("e", 1, 0, 0, 10, 1, "stall"), ("e", 2, 10, 10, 20, 2, "stall"),
        ("f", 1, 0, 0, 4, 1, "finished"), ("f", 2, 20, 20, 20, 3, "finished"),
        ("r", 1, 0, 0, 10, 5, "stall"), ("s", 1, 0, 0, 10, 50, "stall"),
    ]


def test_a_silent_source_is_reported_while_it_is_silent(spark):
    """The stall of source q comes out as other sources move the watermark: q itself never shows up again."""
    rows = [("q", 0, 1, False, 0), ("z", 0, 1, False, 0), ("z", 100, 2, False, 1)]
    assert watched(spark, rows, 2) == [("q", 1, 0, 0, 10, 1, "stall")]


def plain_edit(rows: list[dict], edit: dict):
    """The rules over a list that is built and sorted anew for each edit."""
    ids, by = list(dict.fromkeys(edit["page_ids"] or [])), {p["page_id"]: p for p in rows}
    holder = next((p for p in rows if p["rep_ordinal"] == edit["to_ordinal"]), None)
    if edit["kind"] in ("add", "replace"):
        if edit["kind"] == "add":
            if holder:
                return rows, "no_op", "AlreadySelected", holder["page_id"]
            page = {"page_id": edit["new_id"], "origin": "manual", "origin_segment_ix": None}
        else:
            page = by.get(ids[0]) if ids else None
            if page is None:
                return rows, "rejected", "UnknownPage", None
            if holder:
                return rows, *(("no_op", "SameSample") if holder is page else ("rejected", "DuplicateSample")), page["page_id"]
        new = page | {"rep_ordinal": edit["to_ordinal"], "ticks": edit["to_ticks"], "derived_segment_ix": edit["to_segment_ix"], "last_edit": edit["kind"]}
        return sorted([*(p for p in rows if p is not page), new], key=lambda p: p["ticks"]), "changed", None, new["page_id"]
    if any(i not in by for i in ids):
        return rows, "rejected", "UnknownPage", None
    if edit["kind"] == "merge":
        if len(ids) < 2:
            return rows, "no_op", "NeedMultiplePages", ids[0] if ids else None
        last = max((by[i] for i in ids), key=lambda p: p["ticks"])
        return [p for p in rows if p is last or p["page_id"] not in ids], "changed", None, last["page_id"]
    if not ids:
        return rows, "no_op", "EmptySelection", None
    first = min(k for k, p in enumerate(rows) if p["page_id"] in ids)
    left = [p for p in rows if p["page_id"] not in ids]
    return left, "changed", None, left[min(first, len(left) - 1)]["page_id"] if left else None


def random_log(seed: int, n: int, places: int):
    rnd = random.Random(seed)
    rows = [{"page_id": f"p{k}", "rep_ordinal": 3 * k, "ticks": 30 * k, "origin": "auto", "origin_segment_ix": k, "derived_segment_ix": k, "last_edit": None} for k in range(6)]
    log = []
    for seq in range(1, n + 1):
        kind = rnd.choice(["add", "add", "add", "replace", "delete", "merge"])
        at = rnd.randrange(places)
        some = [f"p{k}" for k in range(6)] + [f"n{k}" for k in range(max(1, seq - 12), seq)]
        ids = None if kind == "add" else rnd.sample(some, rnd.choice([0, 1, 1, 2, 3]))
        log.append({"seq": seq, "kind": kind, "page_ids": ids, "to_ordinal": at, "to_ticks": 10 * at, "to_segment_ix": at // 5, "new_id": f"n{seq}"})
    return rows, log


def test_the_index_equals_plain_lists():
    for seed in range(6):
        rows, log = random_log(seed, 400, 60)
        index, plain = PageIndex(rows), rows
        for edit in log:
            told = index.apply(edit)
            plain, *want = plain_edit(plain, edit)
            assert list(told) == want
        assert index.rows() == plain
        assert apply_edit(rows, log[0]) == plain_edit(rows, log[0])


def test_a_hundred_thousand_edits_of_one_source_take_seconds():
    rows, log = random_log(1, 100_000, 1_000_000)
    index, began = PageIndex(rows), time.perf_counter()
    for edit in log:
        index.apply(edit)
    assert time.perf_counter() - began < 20 and len(index) > 10_000


def test_a_late_replay_starts_from_a_snapshot(spark):
    own, edits = [], []
    for source, seed in (("a", 1), ("b", 2), ("c", 3)):
        rows, log = random_log(seed, 90 if source != "c" else 7, 60)
        own += [(source, *(p[c] for c in pages.PAGE[1:])) for p in rows if source != "b"]
        edits += [(source, e["seq"], e["kind"], e["page_ids"], e["to_ordinal"], e["to_ticks"], e["to_segment_ix"]) for e in log]
    first = spark.createDataFrame(own, pages.PAGE_SCHEMA)
    log = spark.createDataFrame(edits, "source_id string, seq long, kind string, page_ids array<string>, to_ordinal int, to_ticks long, to_segment_ix int")
    full = pages.replay(first, log, every=20)
    kept = full.where("row = 'snapshot'").cache()
    assert {(r["source_id"], r["seq"]) for r in kept.select("source_id", "seq").distinct().collect()} == {(s, k) for s in "ab" for k in (20, 40, 60, 80)}
    for upto in (7, 40, 55, 90):
        want = pages.replay(first, log.where(F.col("seq") <= upto))
        got = pages.replay_from(first, kept, log, upto)
        page_rows = lambda df: sorted(map(repr, df.where("row = 'page'").collect()))
        assert page_rows(got) == page_rows(want)
        assert got.where("row = 'outcome'").count() == sum(upto - (upto // 20 * 20 if s != "c" else 0) if s != "c" else min(upto, 7) for s in "abc")


@pytest.mark.parametrize("seed", [1, 2])
def test_live_pages_equal_the_replay(spark, seed):
    rows, log = random_log(seed, 60, 40)
    load = [("a", 0, "load", None, p["rep_ordinal"], p["ticks"], p["derived_segment_ix"], p["page_id"]) for p in rows]
    edits = [("a", e["seq"], e["kind"], e["page_ids"], e["to_ordinal"], e["to_ticks"], e["to_segment_ix"], e["new_id"]) for e in log]
    stream = spark.createDataFrame(load + edits, "source_id string, seq long, kind string, page_ids array<string>, to_ordinal int, to_ticks long, to_segment_ix int, new_id string")
    got = runs.run_in_turns(stream, ["seq < 10", "seq BETWEEN 10 AND 40", "seq > 40"], live.live_edits).orderBy("seq").collect()
    plain, want = rows, []
    for edit in log:
        plain, *told = plain_edit(plain, edit)
        want.append((edit["seq"], *told, len(plain)))
    assert [(r["seq"], r["status"], r["code"], r["focus"], r["n_pages"]) for r in got] == want
