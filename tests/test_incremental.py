"""Incremental runs: unchanged sources are kept without a look at their frames; attempts that broke off are swept."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.plans import incremental, publish


def sources(spark, *rows):
    return spark.createDataFrame(list(rows), "source_id string, size_bytes long, fingerprint string, settings_key string")


def test_only_changed_sources_are_analysed(spark, tmp_path):
    store, asked = publish.Store(spark, str(tmp_path / "store")), []

    def analyse(value):
        def work(wanted):
            asked.append(sorted(r["source_id"] for r in wanted.collect()))
            return {"pages": wanted.select("source_id", F.lit(value).alias("found"))}

        return work

    first = sources(spark, ("a", 1, "x", "k"), ("b", 2, "y", "k"), ("c", 3, None, "k"), ("gone", 4, "z", "k"))
    assert incremental.incremental_run(store, "r1", first, analyse(1)) == "published"
    second = sources(spark, ("a", 1, "x", "k"), ("b", 2, "other", "k"), ("c", 3, None, "k"), ("new", 5, "n", "k"))
    incremental.incremental_run(store, "r2", second, analyse(2), "r1")
    third = sources(spark, ("a", 1, "x", "k2"), ("b", 2, "other", "k"), ("c", 3, None, "k"), ("new", 5, "n", "k"))
    incremental.incremental_run(store, "r3", third, analyse(3), "r2")
    assert asked == [["a", "b", "c", "gone"], ["b", "new"], ["a"]]
    rows = lambda run, name: sorted((tuple(r) for r in store.read(run, name).collect()), key=repr)
    assert rows("r2", "pages") == [("a", 1), ("b", 2), ("c", 1), ("new", 2)]
    assert rows("r3", "pages") == [("a", 3), ("b", 2), ("c", 1), ("new", 2)]
    assert rows("r3", "lineage") == sorted([("a", "r3", "settings_key"), ("b", "r2", None), ("c", "r1", None), ("new", "r2", None)], key=repr)
    incremental.incremental_run(store, "r4", third, analyse(4), "r3")
    assert asked[-1] == [] and rows("r4", "pages") == rows("r3", "pages")


def test_broken_attempts_are_swept(spark, tmp_path):
    store = publish.Store(spark, str(tmp_path / "store"))
    table = spark.createDataFrame([("a", 1)], "source_id string, n int")
    store.publish("r1", {"t": table})
    store.publish("r1", {"t": table}, overwrite=True)
    (tmp_path / "store" / "run_id=r1" / "left-behind" / "t").mkdir(parents=True)
    assert [p.rsplit("/", 1)[1] for p in store.sweep("r1")] == ["left-behind"]
    assert store.sweep("r1") == [] and store.read("r1", "t").count() == 1 and store.runs().count() == 1
