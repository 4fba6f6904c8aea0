"""Rationals, geometry, lookups, packets, edits, jobs, documents, publication and streams on hand-made rows."""

from __future__ import annotations

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from frameloom.functions import geometry, rational
from frameloom.functions.edit_fold import apply_edit
from frameloom.functions.names import nfc_casefold
from frameloom.operators import checks, jobs, lookups, pages, policies
from frameloom.plans import publish
from frameloom.sources import packets
from frameloom.sources import timelines as documents
from frameloom.sources.fingerprint import fingerprint, read_fingerprints


def test_rounding_equals_fractions(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(-10**15, 10**15), rnd.randrange(1, 50)) for _ in range(300)] + [(k, 2) for k in range(-9, 10)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", rational.div_floor(F.col("a"), F.col("b")), rational.div_ceil(F.col("a"), F.col("b")), rational.div_half_even(F.col("a"), F.col("b"))).collect()
    for a, b, low, high, even in got:
        assert (low, high, even) == (a // b, -(-a // b), round(Fraction(a, b)))


def test_projection_keeps_a_pixel_and_rejects_outside(spark):
    row = spark.range(1).select(F.struct(F.lit(9).alias("x"), F.lit(0).alias("y"), F.lit(1).alias("width"), F.lit(10).alias("height")).alias("r"))
    size = lambda *v: [F.lit(x).cast("long") for x in v]
    assert tuple(row.select(geometry.project_rect(F.col("r"), *size(10, 10, 3, 3)).alias("p")).first()["p"]) == (2, 0, 1, 3)
    assert row.select(geometry.project_rect(F.col("r"), *size(9, 10, 3, 3)).alias("p")).first()["p"] is None


def test_nearest_sample_ties_and_ends(spark):
    samples = spark.createDataFrame([("a", k, t) for k, t in enumerate([10, 20, 31])], "source_id string, ordinal int, ticks long")
    asks = spark.createDataFrame([("a", 15, 1, "tie"), ("a", 51, 2, "tie2"), ("a", 52, 2, "late"), ("a", 0, 1, "before"), ("a", 99, 1, "after"), ("a", 20, 1, "exact"), ("b", 1, 1, "none")], "source_id string, at_num long, at_den long, name string")
    got = {r["name"]: r["ordinal"] for r in lookups.nearest_sample(asks, samples).collect()}
    assert got == {"tie": 0, "tie2": 1, "late": 2, "before": 0, "after": 2, "exact": 1}


def test_covering_segment_is_half_open(spark):
    segments = spark.createDataFrame([("a", 0, 0, 10), ("a", 1, 10, 20)], "source_id string, segment_ix int, start_ticks long, end_ticks long")
    asks = spark.createDataFrame([("a", t, str(t)) for t in (0, 9, 10, 19, 20, 25)], "source_id string, ticks long, name string")
    got = {r["name"]: r["segment_ix"] for r in lookups.covering_segment(asks, segments).collect()}
    assert got == {"0": 0, "9": 0, "10": 1, "19": 1, "20": None, "25": None}


@pytest.mark.parametrize(("times", "duration", "policy"), [([0, 5], 9, "half"), ([0, 6], 9, "all"), ([5, 9], 14, "half"), ([5, 9], 16, "all"), ([0, 3], 9, "all"), ([-1, 3], 9, None), ([0, 3, 3], 5, None), ([0, 3], 3, None)])
def test_gap_policy(spark, times, duration, policy):
    rows = spark.createDataFrame([("a", t) for t in times], "source_id string, ticks long")
    row = policies.gap_policy(rows, spark.createDataFrame([("a", duration)], "source_id string, duration_ticks long"), 6).first()
    assert row["policy"] == policy and (row["reject_code"] is None) == (policy is not None)


def test_packet_lines(spark):
    lines = [("a", 0, "pts=5|flags=K__"), ("a", 1, "pts=6|flags=___"), ("a", 2, "x=1|flags=_K|pts=9|"), ("b", 0, "pts=1|flags=K"), ("b", 1, "pts=1|flags=K"), ("c", 0, "pts=N/A|flags=K"), ("d", 0, "pts=-4|flags=K"), ("e", 0, "flags=K"), ("f", 0, "pts=N/A|flags=_")]
    origins = spark.createDataFrame([(s, 0) for s in "abcdef"], "source_id string, origin_pts long")
    good, bad = packets.key_packets(spark.createDataFrame(lines, "source_id string, line_no int, value string"), origins)
    assert sorted((r["source_id"], r["pts"]) for r in good.collect()) == [("a", 5), ("a", 9)]
    assert sorted(r["source_id"] for r in bad.collect()) == ["b", "c", "d", "e"]


def test_reference_checks(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("a", None)], "source_id string, ref int")
    known = spark.createDataFrame([("a", 1)], "source_id string, id int")
    assert sorted(map(tuple, checks.missing_references(rows, "ref", known, "id").collect())) == [("a", 2), ("b", 1)]
    assert [tuple(r) for r in checks.present_references(rows, "ref", known, "id").collect()] == [("a", 1)]


def test_edits_by_hand():
    page = lambda i, t: {"page_id": i, "rep_ordinal": t, "ticks": t, "origin": "auto", "origin_segment_ix": 0, "derived_segment_ix": 0, "last_edit": None}
    rows = [page("x", 1), page("y", 2), page("z", 3)]
    edit = lambda kind, ids=(), at=None: {"kind": kind, "page_ids": list(ids), "to_ordinal": at, "to_ticks": at, "to_segment_ix": 0, "new_id": "n"}
    assert apply_edit(rows, edit("add", at=2))[1:] == ("no_op", "AlreadySelected", "y")
    assert [p["page_id"] for p in apply_edit(rows, edit("add", at=0))[0]] == ["n", "x", "y", "z"]
    assert apply_edit(rows, edit("replace", ["q"], 9))[1:3] == ("rejected", "UnknownPage")
    assert apply_edit(rows, edit("replace", ["x"], 1))[1:3] == ("no_op", "SameSample")
    assert apply_edit(rows, edit("replace", ["x"], 2))[1:3] == ("rejected", "DuplicateSample")
    assert [p["page_id"] for p in apply_edit(rows, edit("replace", ["x"], 9))[0]] == ["y", "z", "x"]
    assert apply_edit(rows, edit("delete", ["y", "z"]))[3] == "x" and apply_edit(rows, edit("delete", ["x"]))[3] == "y"
    assert apply_edit(rows, edit("delete", ["x", "q"]))[1] == "rejected" and apply_edit(rows, edit("delete"))[1] == "no_op"
    assert [p["page_id"] for p in apply_edit(rows, edit("merge", ["x", "z"]))[0]] == ["y", "z"]
    assert apply_edit(rows, edit("merge", ["x"]))[1:] == ("no_op", "NeedMultiplePages", "x")


def test_merge_and_delete_tables(spark):
    rows = [("a", i, k, 10 * k, "auto", k, k, None) for k, i in enumerate("wxyz")]
    table = spark.createDataFrame(rows, pages.PAGE_SCHEMA)
    edit = lambda *ids: spark.createDataFrame([("a", 1, list(ids))], "source_id string, seq long, page_ids array<string>")
    left, out = pages.merge_pages(table, edit("w", "y", "w"))
    assert sorted(r["page_id"] for r in left.collect()) == ["x", "y", "z"] and out.first()["focus"] == "y"
    left, out = pages.delete_pages(table, edit("y", "z"))
    assert sorted(r["page_id"] for r in left.collect()) == ["w", "x"] and out.first()["focus"] == "x"
    assert pages.delete_pages(table, edit("y", "?"))[0].count() == 4


def test_batch_summary_and_collisions(spark):
    rows = [("b", 1, "success"), ("b", 2, "cancelled"), ("b", 3, "error"), ("c", 1, "error"), ("c", 2, "success"), ("d", 1, "success")]
    got = {r["batch"]: (r["status"], r["exit_code"], r["outcomes"]) for r in jobs.batch_summary(spark.createDataFrame(rows, "batch string, job_ix int, status string")).collect()}
    assert got == {"b": ("cancelled", 130, "success,cancelled,skipped"), "c": ("error", 1, "error,success"), "d": ("success", 0, "success")}
    inputs = spark.createDataFrame([(1, "in/Straße.mp4"), (2, "x/STRASSE.mkv"), (3, "in/café.mp4"), (4, "in/café.mov"), (5, "in/lone.mp4"), (6, "OUT/lone.slides.PDF")], "job_ix int, input string")
    got = jobs.output_collisions(jobs.plan_outputs(inputs, "out", with_json=False)).collect()
    assert sorted((r["job_ix"], r["reason"]) for r in got) == [(1, "SharedTarget"), (2, "SharedTarget"), (3, "SharedTarget"), (4, "SharedTarget"), (5, "TargetIsInput")]
    assert spark.createDataFrame([("ß",), (None,)], "s string").select(nfc_casefold("s").alias("k")).collect()[0]["k"] == "ss"


def test_fingerprint_blocks(spark):
    import hashlib

    for n in (0, 1, 4, 5, 7, 8, 13):
        data = bytes(range(n))
        size = min(n, 4)
        places = sorted({0, (n - size) // 2, n - size})
        want = hashlib.sha256(b"size:%d\n" % n + b"".join(b"%d:%d\n" % (p, size) + data[p : p + size] for p in places)).hexdigest() if n else None
        assert spark.createDataFrame([(data,)], "c binary").select(fingerprint(F.col("c"), 4).alias("f")).first()["f"] == want


def test_fingerprints_of_files_by_range_reads(spark, tmp_path):
    import hashlib

    big = 5 * 2**30 + 3
    with open(tmp_path / "big one.mp4", "wb") as file:  # sparse: above what one binary value can hold
        file.write(b"head")
        file.seek(big - 4)
        file.write(b"tail")
    (tmp_path / "small.mp4").write_bytes(b"0123456")
    (tmp_path / "empty.mp4").write_bytes(b"")
    got = {r["path"].rsplit("/", 1)[1].replace("%20", " "): (r["size_bytes"], r["fingerprint"]) for r in read_fingerprints(spark, str(tmp_path)).collect()}
    block, mid = 1 << 20, (big - (1 << 20)) // 2
    lines = b"size:%d\n" % big + b"0:%d\n" % block + b"head".ljust(block, b"\0") + b"%d:%d\n" % (mid, block) + bytes(block) + b"%d:%d\n" % (big - block, block) + b"tail".rjust(block, b"\0")
    assert got["big one.mp4"] == (big, hashlib.sha256(lines).hexdigest())
    assert got["small.mp4"] == (7, hashlib.sha256(b"size:7\n0:7\n0123456").hexdigest())
    assert len(got) == 2


def test_strict_documents(spark):
    texts = ["{}", "[1", None, '{"schema_version":1,"schema_version":2}', '{"a":NaN}', "{} x"]
    good, bad = documents.parse(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, document string"))
    assert good.count() == 0
    assert {r["k"]: r["fault"] for r in bad.collect()} == {0: "document: fields", 1: "json: malformed", 2: "json: null", 3: "json: duplicate field", 4: "json: not a finite number", 5: "json: malformed"}


def test_a_run_is_visible_only_with_its_manifest(spark, tmp_path):
    store = publish.Store(spark, str(tmp_path / "runs"))
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    with pytest.raises(ValueError, match="guards"):
        store.publish("r1", {"t": rows}, guards={"bad": rows})
    with pytest.raises(ValueError, match="no published"):
        store.read("r1", "t")
    assert store.publish("r1", {"t": rows}) == "published"
    assert sorted(map(tuple, store.read("r1", "t").collect())) == [(1, "a"), (2, None)]
    with pytest.raises(publish.RunExists):
        store.publish("r1", {"t": rows})
    assert store.publish("r1", {"t": rows.limit(1)}, overwrite=True) == "published"
    assert store.read("r1", "t").count() == 1 and store.runs().count() == 1
    assert publish.digest(rows) == publish.digest(rows.repartition(3).select("v", "k"))


def test_an_overwrite_that_breaks_off_leaves_the_old_run(spark, tmp_path, monkeypatch):
    store = publish.Store(spark, str(tmp_path / "runs"))
    rows = spark.range(20).withColumn("v", F.col("id") * 2)
    assert store.publish("r", {"a": rows, "b": rows}) == "published"
    broken = rows.withColumn("v", F.when(F.col("id") == 19, F.raise_error(F.lit("lost"))).otherwise(F.col("v")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        store.publish("r", {"a": rows.limit(3), "b": broken}, overwrite=True)
    assert store.read("r", "a").count() == store.read("r", "b").count() == 20
    assert store.publish("r", {"a": rows.limit(3)}, overwrite=True) == "published"
    assert store.read("r", "a").count() == 3
    with pytest.raises(ValueError, match="no published"):
        store.read("r", "b")
    assert store.runs().count() == 1


def test_rows_that_change_on_their_way_are_seen(spark, tmp_path, monkeypatch):
    """The digest of the source's rows is held against the files', not the files' against themselves."""
    store = publish.Store(spark, str(tmp_path / "runs"))
    real = publish.digest
    monkeypatch.setattr(publish, "digest", lambda df: real(df.where("id <> 3")))
    assert store.publish("r", {"a": spark.range(9)}) == "published_unverified"


def test_masked_sources_are_cut_alike_live_and_in_batch(spark):
    from frameloom.plans import flagship
    from frameloom.settings import SpatialSettings
    from frameloom.streaming import live, runs

    from .test_detectors import SCHEMA, movie

    settings = SpatialSettings(pixel_delta=20, edge_delta=25, tile=3, cell_changed_fraction=0.5, changed_fraction=0.25, cell_fraction=0.25, overlay_missing_edges=1)
    rows = movie(8, 24, excluded=(0, 0, 5, 5)) + movie(8, 24, source="b")
    # Two more sources change in five rows at every frame; these rows are masked in one of them.
    for name, mask in (("c", (0, 0, 8, 5)), ("d", None)):
        rows += [(name, k, 100 * k, 8, 7, [240 * (k % 2)] * 40 + [10] * 16, mask) for k in range(24)]
    frames = spark.createDataFrame(rows, SCHEMA)
    samples = frames.select("source_id", "ordinal", F.col("pts").alias("ticks"))
    sources = samples.groupBy("source_id").agg((F.max("ticks") + 5).alias("duration_ticks"), F.lit(1).cast("long").alias("tb_num"), F.lit(1000).cast("long").alias("tb_den"))
    batch = flagship.analyse(frames.drop("pts"), sources, samples, settings).numbered.groupBy("source_id").agg(F.max("segment_ix").alias("n"))
    live_rows = runs.run_in_turns(frames.withColumn("is_end", F.lit(False)), ["ordinal < 9", "ordinal >= 9"], lambda stream: live.live_segments(stream, settings))
    closed = live_rows.where("row = 'segment'").groupBy("source_id").count()
    want = {r["source_id"]: r["n"] for r in batch.collect()}
    got = {r["source_id"]: r["count"] for r in closed.collect()}
    assert {k: got.get(k, 0) for k in want} == want
    assert (want["c"], want["d"]) == (0, 23)


def test_repeated_edits_are_rejected(spark):
    from frameloom.streaming import live, runs

    schema = "source_id string, seq long, kind string, page_ids array<string>, to_ordinal int, to_ticks long, to_segment_ix int, new_id string"
    rows = [("a", 0, "load", None, 1, 10, 0, "p1"), ("a", 0, "load", None, 5, 50, 1, "p2"), ("a", 3, "delete", ["p1"], None, None, None, None), ("a", 2, "delete", ["p2"], None, None, None, None), ("a", 4, "delete", ["p1"], None, None, None, None)]
    log = spark.createDataFrame([(*r, t) for r, t in zip(rows, (0, 0, 1, 2, 3), strict=True)] + [(*rows[2], 2)], schema + ", turn int")
    got = [tuple(r) for r in runs.run_in_turns(log, [f"turn = {k}" for k in range(4)], live.live_edits).select("seq", "status", "code", "n_pages").collect()]
    assert sorted(got, key=repr) == sorted([(3, "changed", None, 1), (2, "rejected", "OutOfOrder", 1), (3, "rejected", "OutOfOrder", 1), (4, "rejected", "UnknownPage", 1)], key=repr)


def test_lookups_by_stretches_equal_those_by_source(spark):
    """Long sources are cut into stretches: whatever their length, finds are carried over empty ones, and ties stay."""
    rnd = random.Random(5)
    ticks = {s: sorted(rnd.sample(range(-300, 700), 12)) for s in ("a", "b")}
    samples = spark.createDataFrame([(s, k, t) for s, own in ticks.items() for k, t in enumerate(own)], "source_id string, ordinal int, ticks long")
    segments = spark.createDataFrame([(s, k, t, u) for s, own in ticks.items() for k, (t, u) in enumerate(zip(own, [*own[1:], own[-1] + 9], strict=True))], "source_id string, segment_ix int, start_ticks long, end_ticks long")
    asks = spark.createDataFrame([(s, rnd.randint(-900, 1500), rnd.choice([1, 2, 3]), k) for k, s in enumerate(["a", "b", "c"] * 60)], "source_id string, at_num long, at_den long, name int")
    at = asks.select("source_id", F.col("at_num").alias("ticks"), "name")
    near, cover = (sorted(x.collect(), key=repr) for x in (lookups.nearest_sample(asks, samples), lookups.covering_segment(at, segments)))
    assert len(near) == 120 and len(cover) == 180
    for stretch in (1, 50, 10_000):
        assert sorted(lookups.nearest_sample(asks, samples, stretch).collect(), key=repr) == near
        assert sorted(lookups.covering_segment(at, segments, stretch).collect(), key=repr) == cover
