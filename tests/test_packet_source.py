"""Packet indexes by byte ranges: every line once, in order, whatever the ranges; growing files as a stream."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from frameloom.sources import packet_source as ps
from frameloom.sources import packets
from frameloom.streaming import live


def written(path, seed: int, n: int, last_break: bool = True, long: bool = False) -> list[tuple[int, str]]:
    rnd, data, lines = random.Random(seed), b"", []
    for k in range(n):
        text = f"pts={40 * k}|flags={'K__' if k % 3 == 0 else '___'}" + ("é" * rnd.randrange(9)) + ("x" * 300 if long and rnd.random() < 0.1 else "")
        if rnd.random() < 0.1:
            data += b"\n"
        lines.append((len(data), text))
        data += text.encode() + (b"\n" if last_break or k < n - 1 else b"")
    path.write_bytes(data)
    return lines


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("chunk", [16, 1 << 20])
def test_every_line_falls_into_one_range(tmp_path, size, chunk, monkeypatch):
    monkeypatch.setattr(ps, "CHUNK_BYTES", chunk)
    for last in (True, False):
        want = written(tmp_path / "a.txt", 5, 60, last, long=True)
        found = [r for part in ps.ranges(str(tmp_path / "a.txt"), 0, (tmp_path / "a.txt").stat().st_size, size) for b in ps.lines_of(part) for r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        assert found == want


def test_an_index_is_read_by_many_tasks_in_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    want = {}
    for name, n in (("a.txt", 4000), ("b.txt", 1), ("_hidden", 5)):
        want[name] = written(tmp_path / "in" / name, 1, n)
    (tmp_path / "in" / "empty.txt").write_bytes(b"")
    got = ps.read_packet_lines(spark, str(tmp_path / "in"), 5000)
    assert got.rdd.getNumPartitions() > 15
    by = {}
    for r in got.orderBy("source_id", "line_no").collect():
        by.setdefault(r["source_id"].rsplit("/", 1)[1], []).append((r["line_no"], r["value"]))
    assert by == {k: v for k, v in want.items() if k != "_hidden"}
    origins = got.select("source_id", F.lit(0).cast("long").alias("origin_pts")).distinct()
    good, bad = packets.key_packets(got, origins)
    assert good.count() == 1334 + 1 and bad.count() == 0
    assert ps.read_packet_lines(spark, str(tmp_path / "in" / "empty.txt")).count() == 0


def test_a_growing_index_is_a_stream(spark, tmp_path):
    """Three turns: half a line waits for its rest, a new file comes, and the gap policy of both is put out as they end."""
    folder = tmp_path / "in"
    folder.mkdir()

    def turn() -> list[tuple]:
        lines = ps.stream_packet_lines(spark, str(folder), 16)
        fields = lines.select(F.regexp_extract("source_id", "([^/]+)$", 1).alias("source_id"), F.regexp_extract("value", r"pts=(\d+)", 1).cast("long").alias("pts"), F.col("value").contains("end").alias("is_end"))
        with live.rocksdb(spark):
            query = live.live_gap_policy(fields, 50).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination()
        return sorted((r["source_id"], r["n"], r["max_gap"], r["policy"]) for r in spark.read.schema(live.POLICIES).parquet(str(tmp_path / "out")).where("row = 'policy'").collect())

    (folder / "a.txt").write_bytes(b"pts=0|flags=K\npts=40|flags=K\npts=8")
    assert turn() == []
    (folder / "a.txt").write_bytes(b"pts=0|flags=K\npts=40|flags=K\npts=80|flags=K\n")
    (folder / "b.txt").write_bytes(b"pts=10|flags=K\npts=70|end\n")
    assert turn() == [("b.txt", 1, 60, "all")]
    with (folder / "a.txt").open("ab") as file:
        file.write(b"pts=100|end\n")
    assert turn() == [("a.txt", 3, 40, "half"), ("b.txt", 1, 60, "all")]


def test_unknown_stores_say_so():
    with pytest.raises(ValueError, match="pyarrow.fs"):
        ps.listed("nosuch://host/index")


class Counted:
    """A file that counts the bytes read of it."""

    def __init__(self, file, counts: list[int]) -> None:
        self.file, self.counts = file, counts

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def size(self) -> int:
        return self.file.size()

    def read_at(self, n: int, at: int) -> bytes:
        data = self.file.read_at(n, at)
        self.counts.append(len(data))
        return data


def test_a_range_reads_little_more_than_its_own_lines(tmp_path, monkeypatch):
    path, counts, opened = str(tmp_path / "a.txt"), [], ps.opened
    want = written(tmp_path / "a.txt", 3, 30_000)

    class Store:
        def open_input_file(self, place: str) -> Counted:
            return Counted(opened(path)[0].open_input_file(place), counts)

    monkeypatch.setattr(ps, "opened", lambda path: (Store(), path))
    size = (tmp_path / "a.txt").stat().st_size
    parts = ps.ranges(path, 0, size, 64 << 10)
    assert sum(b.num_rows for part in parts for b in ps.lines_of(part)) == len(want)
    assert len(parts) > 5 and sum(counts) < size + len(parts) * (20 << 10)


def test_small_ranges_of_large_files_are_not_a_task_each(monkeypatch):
    monkeypatch.setattr(ps, "listed", lambda path: [("a", 1 << 30), ("b", 5), ("c", 3 << 30)])
    parts = ps.Reader("x", 16 << 10).partitions()
    assert 200 < len(parts) < 400 and all(p.end - p.begin <= ps.RANGE_BYTES for p in parts)
    for name, n in (("a", 1 << 30), ("b", 5), ("c", 3 << 30)):
        own = [(p.begin, p.end) for p in parts if p.path == name]
        assert own[0][0] == 0 and own[-1][1] == n and all(x[1] == y[0] for x, y in zip(own, own[1:], strict=False))
    monkeypatch.setattr(ps, "listed", lambda path: [("a", 100_000)])
    assert {p.end - p.begin for p in ps.Reader("x", 5000).partitions()} == {5000}


@pytest.mark.parametrize("size", [1, 3, 10, 1000])
def test_odd_bytes_of_lines(tmp_path, size):
    """Breaks of two bytes, texts that are no UTF-8 (also where two lines' ends would make a letter), and lines of several bytes a letter."""
    for data in (b"a\r\n\r\nb\r\r\n\n\nc\xc3\n\xa9d\r\ne", "\né\r\n€\U0001f600\n\r".encode(), b"\n\n", b""):
        (tmp_path / "a.txt").write_bytes(data)
        at, want = 0, []
        for line in data.split(b"\n"):
            if line:
                want.append((at, line.removesuffix(b"\r").decode("utf-8", "replace")))
            at += len(line) + 1
        got = [r for part in ps.ranges(str(tmp_path / "a.txt"), 0, len(data), size) for b in ps.lines_of(part) for r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        assert got == want


def test_order_is_checked_over_stretches_too(spark):
    """Sources with a fall, a repeat and a time that is no number, each also across the end of a stretch: the same packets and rejects."""
    rnd, lines = random.Random(4), []
    for s in range(24):
        times = [str(10 * k) for k in range(40)]
        if s % 4:
            k = rnd.choice([19, 20, 21, 33])  # stretches end before lines 10, 20 and 30
            times[k] = {1: times[k - 1], 2: "0", 3: "N/A"}[s % 4]
        lines += [(f"s{s}", 7 * k, f"pts={t}|flags=K__") for k, t in enumerate(times)]
    rows = spark.createDataFrame(lines, "source_id string, line_no long, value string")
    origins = rows.select("source_id", F.lit(0).cast("long").alias("origin_pts")).distinct()
    want = packets.key_packets(rows, origins)
    for stretch in (1, 70, 1000):
        got = packets.key_packets(rows, origins, stretch)
        assert [sorted(map(tuple, x.collect())) for x in got] == [sorted(map(tuple, x.collect())) for x in want]
    assert want[0].count() == 6 * 40 and want[1].count() == 18
