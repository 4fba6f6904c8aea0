"""Lines of key-packet indexes as a Spark data source: files of any size, cut into byte ranges, in batches and as a stream.

A line belongs to the range that it begins in, and its number is the byte it begins at, so lines of a file keep their order whatever task read them,
and a range is read by seeking, not by reading what comes before. As a stream, files may grow and new ones may come: a line is taken once its
line break is there. Files are opened through ``pyarrow.fs`` (local, S3, GCS, HDFS and what else it knows by the scheme); other schemes raise.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source_id string, line_no long, value string"
RANGE_BYTES = 64 << 20
#: Bytes that are read, and put out as one Arrow batch, at once; a longer line is read whole.
CHUNK_BYTES = 4 << 20
#: Bytes in which a line break is looked for first; then twice as many, and so on.
LOOK_BYTES = 4 << 10
#: Ranges of a read, about, from which on they become longer than asked, so that small ranges of large files are not a task each.
MANY = 256


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path (a URI, or local without a scheme) and the place in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    try:
        return fs.FileSystem.from_uri(quote(path, safe=":/@"))
    except (pa.ArrowInvalid, OSError) as e:
        raise ValueError(f"no file system for {scheme}:// here: packet indexes are read through pyarrow.fs, which does not know it") from e


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files at or below a path, in order; names that begin with a dot or an underscore are left out."""
    system, place = opened(path)
    info = system.get_file_info(place)
    files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=True))
    hidden = lambda f: any(part[:1] in "._" for part in f.path.removeprefix(place).strip("/").split("/") if part)
    prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
    return sorted((prefix + f.path, f.size) for f in files if f.type == fs.FileType.File and not hidden(f))


def ranges(path: str, begin: int, end: int, size: int) -> list[Range]:
    return [Range(path, at, min(at + size, end)) for at in range(begin, end, size)]


def planned(spans: list[tuple[str, int, int]], size: int) -> list[Range]:
    """Ranges of (path, begin, end) spans, of ``size`` bytes: neighbouring ones become one where they would be more than ``MANY``, up to ``RANGE_BYTES``."""
    size = max(size, min(RANGE_BYTES, -(-sum(end - begin for _, begin, end in spans) // MANY)))
    return [r for path, begin, end in spans for r in ranges(path, begin, end, size)] or [Range("", 0, 0)]


def _behind_break(file: pa.NativeFile, at: int, size: int) -> int:
    """The byte behind the first line break at or after ``at``, or ``size``."""
    step = min(LOOK_BYTES, CHUNK_BYTES)
    while at < size:
        found = file.read_at(min(step, size - at), at)
        k = found.find(b"\n")
        if k >= 0:
            return at + k + 1
        at, step = at + len(found), min(2 * step, CHUNK_BYTES)
    return size


def lines_of(part: Range) -> Iterator[pa.RecordBatch]:
    """The lines that begin in a range, without their breaks; empty lines are left out. Nothing is read but these lines and the way to their first and last break."""
    system, place = opened(part.path)
    with system.open_input_file(place) as file:
        size = file.size()
        # a line that begins before this range is the range's before; the one that begins last in it may end behind it
        at = _behind_break(file, part.begin - 1, size) if part.begin else 0
        end = _behind_break(file, part.end - 1, size)
        rest, start = b"", at
        while start < end:
            data = rest + file.read_at(min(CHUNK_BYTES, end - at), at)
            at = min(end, at + CHUNK_BYTES)
            cut = len(data) if at == end else data.rfind(b"\n") + 1
            if cut:
                yield from _batch(part, start, data[:cut])
            rest, start = data[cut:], start + cut


def _batch(part: Range, start: int, data: bytes) -> Iterator[pa.RecordBatch]:
    flat = np.frombuffer(data, np.uint8)
    breaks = np.flatnonzero(flat == 10)
    begins = np.concatenate([[0], breaks + 1])
    ends = np.append(breaks, len(data))
    keep = (ends > begins) & (start + begins < part.end)
    if keep.any():
        begins, ends = begins[keep], ends[keep]
        ends = ends - (flat[ends - 1] == 13)
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(part.path, pa.string()), len(begins)), pa.array(start + begins, pa.int64()), _texts(data, flat, begins, ends)], names=["source_id", "line_no", "value"])


def _texts(data: bytes, flat: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts between ``begins`` and ``ends``; bytes that are no UTF-8 are replaced."""
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.string())
    inside = np.zeros(len(flat) + 1, np.int8)
    inside[begins] += 1
    inside[ends] -= 1
    offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(flat[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]))


class Reader(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def partitions(self) -> list[Range]:
        return planned([(path, 0, n) for path, n in listed(self.path)], self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return lines_of(partition) if partition.path else iter(())


class StreamReader(DataSourceStreamReader):
    """An offset holds, by file, the byte behind the last whole line."""

    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps({path: whole_lines(path, n) for path, n in listed(self.path)}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        return planned([(path, before.get(path, 0), n) for path, n in sorted(after.items())], self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return lines_of(partition) if partition.path else iter(())


def whole_lines(path: str, size: int) -> int:
    """The byte behind a file's last line break."""
    system, place = opened(path)
    with system.open_input_file(place) as file:
        at = size
        while at > 0:
            begin = max(0, at - CHUNK_BYTES)
            k = file.read_at(at - begin, begin).rfind(b"\n")
            if k >= 0:
                return begin + k + 1
            at = begin
    return 0


class PacketLines(DataSource):
    """``spark.read.format("packet_lines").option("range_bytes", n).load(path)``, and the same with ``readStream``.

    ``range_bytes`` is the least length of a range: a task takes several neighbouring ones where a read would have more than ``MANY``.
    """

    @classmethod
    def name(cls) -> str:
        return "packet_lines"

    def schema(self) -> str:
        return SCHEMA

    def _asked(self) -> tuple[str, int]:
        size = int(self.options.get("range_bytes", RANGE_BYTES))
        if not self.options.get("path") or size < 1:
            raise ValueError("packet_lines needs a path and a range of a byte at least")
        return self.options["path"], size

    def reader(self, schema) -> Reader:
        return Reader(*self._asked())

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(*self._asked())


def read_packet_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(PacketLines)
    return spark.read.format("packet_lines").option("range_bytes", range_bytes).load(path)


def stream_packet_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(PacketLines)
    return spark.readStream.format("packet_lines").option("range_bytes", range_bytes).load(path)
