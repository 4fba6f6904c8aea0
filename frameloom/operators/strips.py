"""Frames of real size as strips: up to CHUNK frames of one tile in one row, exchanged once.

A task cuts the frames of a batch into strips straight away, a row a tile and batch rather than a row a tile and frame. Strips are exchanged
once by (source, chunk of ordinals, tile), where the parts that several batches hold of one are put together, and staged with that partitioning. All that
follows meets them there: the last frame of each strip (one frame of CHUNK) goes to the next strip of its tile for the changes between
neighbours, the numbers of the segments come as a few integers a strip. A segment that lies inside one chunk is finished in its strip, in
one pass. Of one that spans chunks, only vectors leave the strips, one a chunk and tile: tops, then counts of marks and edges; each is merged by a group
that streams over them (Arrow batches, one running vector), so a segment of any length takes the memory of one tile.

A source has one mask. Ordinals need not be contiguous.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.staging import staged
from ..settings import SpatialSettings
from . import kernels
from .tiles import edge_flags

#: Ordinals of a chunk.
CHUNK = 256
KEY = ["source_id", "chunk", "ty", "tx"]
SEGMENT = ["source_id", "segment_ix", "ty", "tx"]
_PARTS = "source_id string, chunk int, ty int, tx int, ordinals binary, px binary, edge binary, ok binary"
_CHANGES = "source_id string, ordinal int, prev_ordinal int, ty int, tx int, valid int, changed int"
_SCORES = "source_id string, segment_ix int, ty int, tx int, ordinal int, valid int, marked int, lost int, retained int, transient int, missing int"
_TOPS = "source_id string, segment_ix int, ty int, tx int, chunk int, top binary, n_frames long"
_COUNTS = "source_id string, segment_ix int, ty int, tx int, chunk int, top binary, n_frames long, marks binary, edges binary"
_HELD = "source_id string, chunk int, ty int, tx int, segment_ix int, top binary, n_frames long, supported binary, core binary"


def cut_strips(frames: DataFrame, tile: int, edge_delta: int, chunk: int = CHUNK) -> DataFrame:
    """Strips (source_id, chunk, ty, tx, ok, parts) of frames whose gray is one binary value; the one exchange of pixels, staged."""
    masked = "excluded" in frames.columns
    columns = [F.col(c) for c in ("source_id", "ordinal", "width", "height", "gray")]
    columns += [F.col(f"excluded.{c}").alias(f"e_{c}") if masked else F.lit(None).cast("int").alias(f"e_{c}") for c in ("x", "y", "width", "height")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple, list[tuple]] = {}
            for row in batch.to_pylist():  # a frame is one binary value: no object a pixel
                alike = (row["source_id"], row["ordinal"] // chunk, row["height"], row["width"], row["e_y"], row["e_x"], row["e_height"], row["e_width"])
                groups.setdefault(alike, []).append((row["ordinal"], row["gray"]))
            for (source, number, h, w, y, x, eh, ew), own in groups.items():
                own.sort(key=lambda f: f[0])
                ordinals = np.array([o for o, _ in own], "<i4").tobytes()
                px = np.frombuffer(b"".join(g for _, g in own), np.uint8).reshape(-1, h, w)
                edge = np.stack([edge_flags(f, edge_delta) for f in px])
                ok = np.ones((h, w), bool)
                if x is not None:
                    ok[y : y + eh, x : x + ew] = False
                places = [(a, b) for a in range(0, h, tile) for b in range(0, w, tile)]
                part = lambda v, a, b: v[..., a : a + tile, b : b + tile]
                told = {
                    "source_id": [source] * len(places), "chunk": pa.array([number] * len(places), pa.int32()), "ty": pa.array([a // tile for a, _ in places], pa.int32()), "tx": pa.array([b // tile for _, b in places], pa.int32()),
                    "ordinals": pa.array([ordinals] * len(places), pa.binary()), "px": pa.array([part(px, a, b).tobytes() for a, b in places], pa.binary()),
                    "edge": pa.array([np.packbits(part(edge, a, b)).tobytes() for a, b in places], pa.binary()), "ok": pa.array([part(ok, a, b).tobytes() for a, b in places], pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(told)

    kernels.small_batches(frames.sparkSession)
    parts = frames.select(*columns).mapInArrow(cut, _PARTS)
    return staged(parts.groupBy(*KEY).agg(F.first("ok").alias("ok"), F.collect_list(F.struct("ordinals", "px", "edge")).alias("parts")))


class Strip:
    """A row's parts in time order: px (frames by pixels), edge and ok."""

    def __init__(self, parts: list[dict], ok: bytes) -> None:
        self.ok = np.frombuffer(ok, bool)
        n = len(self.ok)
        ordinals = [np.frombuffer(p["ordinals"], "<i4") for p in parts]
        px = np.concatenate([np.frombuffer(p["px"], np.uint8).reshape(-1, n) for p in parts])
        edge = np.concatenate([np.unpackbits(np.frombuffer(p["edge"], np.uint8), count=len(o) * n).astype(bool).reshape(-1, n) for p, o in zip(parts, ordinals, strict=True)])
        at = np.concatenate(ordinals)
        order = np.argsort(at, kind="stable")
        self.ordinals, self.px, self.edge = at[order], px[order], edge[order]

    def runs(self, segments: list[dict]) -> Iterator[tuple[int, int, slice]]:
        """(segment, how many frames it has in all, its frames here)."""
        number = {s["ordinal"]: (s["segment_ix"], s["total"]) for s in segments}
        own = [number[o] for o in self.ordinals.tolist()]
        starts = [k for k in range(len(own)) if k == 0 or own[k][0] != own[k - 1][0]]
        for a, b in zip(starts, [*starts[1:], len(own)], strict=True):
            yield (*own[a], slice(a, b))


def _mapped(rows: DataFrame, schema: str, work: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    """``work`` on each row of strips; it gives columns' values a row, or arrays of equal length."""
    fields = [f.split() for f in schema.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[k] for _, k in fields]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = [x for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist() for x in work(row)]
        if not found:
            return None
        columns = [[v for f in found for v in f[c]] for c in range(len(fields))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[n for n, _ in fields])

    return kernels.mapped(rows, schema, run)


def strip_changes(strips: DataFrame, pixel_delta: int) -> DataFrame:
    """The rows of ``changes.tile_changes``; a strip's first frame is compared with the last one of the strip before."""

    def last(row: dict) -> Iterator[tuple]:
        strip = Strip(row["parts"], row["ok"])
        yield ([row["source_id"]], [row["chunk"]], [row["ty"]], [row["tx"]], [int(strip.ordinals[-1])], [strip.px[-1].tobytes()])

    ends = _mapped(strips, "source_id string, chunk int, ty int, tx int, prev_ordinal int, prev_px binary", last)
    before = Window.partitionBy("source_id", "ty", "tx").orderBy("chunk")
    ends = ends.select(*KEY, *(F.lag(c).over(before).alias(c) for c in ("prev_ordinal", "prev_px")))  # one frame of a strip

    def compare(row: dict) -> Iterator[tuple]:
        strip = Strip(row["parts"], row["ok"])
        valid = int(strip.ok.sum())
        px, ordinals = strip.px, strip.ordinals
        if row["prev_px"] is not None:
            px, ordinals = np.concatenate([np.frombuffer(row["prev_px"], np.uint8)[None, :], px]), np.append(np.int32(row["prev_ordinal"]), ordinals)
        n = len(px) - 1
        if valid and n:
            apart = np.where(px[1:] > px[:-1], px[1:] - px[:-1], px[:-1] - px[1:])  # unsigned bytes
            changed = ((apart > pixel_delta) & strip.ok).sum(axis=1)
            yield ([row["source_id"]] * n, ordinals[1:].tolist(), ordinals[:-1].tolist(), [row["ty"]] * n, [row["tx"]] * n, [valid] * n, changed.tolist())

    return _mapped(strips.join(ends, KEY), _CHANGES, compare)


def with_segments(strips: DataFrame, numbered: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Strips with, for each of their frames, its segment and how many frames that has; strips stay where they are."""
    totals = numbered.groupBy("source_id", "segment_ix").agg(F.count("*").alias("total"))
    told = numbered.join(totals, ["source_id", "segment_ix"]).withColumn("chunk", F.floor(F.col("ordinal") / chunk).cast("int"))
    by_chunk = told.groupBy("source_id", "chunk").agg(F.collect_list(F.struct("ordinal", "segment_ix", "total")).alias("segments"))
    return strips.join(strips.select(*KEY).join(by_chunk, ["source_id", "chunk"]), KEY)


def _marks(top: np.ndarray, px: np.ndarray, ok: np.ndarray, delta: int) -> np.ndarray:
    return (top.astype(np.int16) - px > delta) & ok


def _flags(marks: np.ndarray, edges: np.ndarray, n: int, settings: SpatialSettings) -> tuple[np.ndarray, np.ndarray]:
    """Pixels that are marked in enough frames, and those that are an edge in enough."""
    return marks >= min(settings.support_samples, n), edges >= max(1, math.ceil(n * settings.core_edge_fraction))


def _scored(row: dict, segment: int, ordinals: np.ndarray, marks: np.ndarray, edge: np.ndarray, ok: np.ndarray, supported: np.ndarray, core: np.ndarray) -> tuple:
    marked, retained, n = marks.sum(axis=1), (marks & supported).sum(axis=1), len(ordinals)
    lost = (core & ~(edge & ok)).sum(axis=1)
    places = ([row["source_id"]] * n, [segment] * n, [row["ty"]] * n, [row["tx"]] * n)
    return (*places, ordinals.tolist(), [int(ok.sum())] * n, marked.tolist(), lost.tolist(), retained.tolist(), (marked - retained).tolist(), (int(supported.sum()) - retained).tolist())


def merged_tops(told: DataFrame) -> DataFrame:
    """The brightest values of segments that span chunks, for each of their chunks."""

    def tops(row: dict) -> Iterator[tuple]:
        strip = Strip(row["parts"], row["ok"])
        for segment, total, at in strip.runs(row["segments"]):
            if at.stop - at.start < total:
                yield ([row["source_id"]], [segment], [row["ty"]], [row["tx"]], [row["chunk"]], [strip.px[at].max(axis=0).tobytes()], [at.stop - at.start])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, n, chunks, key = None, 0, [], None
        for batch in batches:
            for data, k in zip(batch.column("top").to_pylist(), batch.column("n_frames").to_pylist(), strict=True):
                own = np.frombuffer(data, np.uint8)
                top, n = own if top is None else np.maximum(top, own), n + k
            chunks += batch.column("chunk").to_pylist()
            key = key or [batch.column(c)[0].as_py() for c in SEGMENT]
        for c in chunks:
            yield pa.RecordBatch.from_arrays([*(pa.array([v], k) for v, k in zip(key, (pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)), pa.array([c], pa.int32()), pa.array([top.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=[*SEGMENT, "chunk", "top", "n_frames"])

    return _mapped(told, _TOPS, tops).groupBy(*SEGMENT).applyInArrow(merge, _TOPS)


def merged_supports(told: DataFrame, tops: DataFrame, settings: SpatialSettings) -> DataFrame:
    """Supported and core pixels of segments that span chunks, for each of their chunks: a second pass over their strips."""
    held = tops.groupBy(*KEY).agg(F.collect_list(F.struct("segment_ix", "top", "n_frames")).alias("held"))

    def count(row: dict) -> Iterator[tuple]:
        strip, held = Strip(row["parts"], row["ok"]), {h["segment_ix"]: h for h in row["held"]}
        for segment, _, at in strip.runs(row["segments"]):
            if segment in held:
                top = np.frombuffer(held[segment]["top"], np.uint8)
                sums = [x.sum(axis=0).astype("<i8").tobytes() for x in (_marks(top, strip.px[at], strip.ok, settings.pixel_delta), strip.edge[at] & strip.ok)]
                yield ([row["source_id"]], [segment], [row["ty"]], [row["tx"]], [row["chunk"]], [held[segment]["top"]], [held[segment]["n_frames"]], [sums[0]], [sums[1]])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, chunks, key, top, n = None, [], None, None, 0
        for batch in batches:
            own = [sum(np.frombuffer(x, "<i8") for x in batch.column(c).to_pylist()) for c in ("marks", "edges")]
            sums = own if sums is None else [a + b for a, b in zip(sums, own, strict=True)]
            chunks += batch.column("chunk").to_pylist()
            if key is None:
                key = [batch.column(c)[0].as_py() for c in SEGMENT]
                top, n = batch.column("top")[0].as_py(), batch.column("n_frames")[0].as_py()
        supported, core = _flags(*sums, n, settings)
        source, segment, ty, tx = key
        for c in chunks:
            values = [source, c, ty, tx, segment, top, n, supported.tobytes(), core.tobytes()]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[f.split()[0] for f in _HELD.split(", ")])

    return _mapped(told.join(held, KEY), _COUNTS, count).groupBy(*SEGMENT).applyInArrow(merge, _HELD)


def strip_scores(told: DataFrame, settings: SpatialSettings) -> DataFrame:
    """The rows of ``representatives.tile_scores`` from strips with their segments."""
    delta = settings.pixel_delta

    def inside(row: dict) -> Iterator[tuple]:
        strip = Strip(row["parts"], row["ok"])
        for segment, total, at in strip.runs(row["segments"]):
            if at.stop - at.start == total:
                px, edge = strip.px[at], strip.edge[at]
                marks = _marks(px.max(axis=0), px, strip.ok, delta)
                supported, core = _flags(marks.sum(axis=0), (edge & strip.ok).sum(axis=0), total, settings)
                yield _scored(row, segment, strip.ordinals[at], marks, edge, strip.ok, supported, core)

    spanning = told.where(F.exists("segments", lambda s: s["total"] > F.size(F.filter("segments", lambda t: t["segment_ix"] == s["segment_ix"]))))
    held = merged_supports(spanning, merged_tops(spanning), settings)
    held = held.groupBy(*KEY).agg(F.collect_list(F.struct("segment_ix", "top", "supported", "core")).alias("held"))

    def across(row: dict) -> Iterator[tuple]:
        strip, held = Strip(row["parts"], row["ok"]), {h["segment_ix"]: h for h in row["held"]}
        for segment, _, at in strip.runs(row["segments"]):
            if segment in held:
                own = held[segment]
                marks = _marks(np.frombuffer(own["top"], np.uint8), strip.px[at], strip.ok, delta)
                yield _scored(row, segment, strip.ordinals[at], marks, strip.edge[at], strip.ok, *(np.frombuffer(own[c], bool) for c in ("supported", "core")))

    scores = _mapped(told, _SCORES, inside).unionByName(_mapped(spanning.join(held, KEY), _SCORES, across))
    covered = (F.col("valid") > 0) & (F.col("marked") / F.col("valid") >= settings.overlay_fraction) & (F.col("lost") >= settings.overlay_missing_edges)
    return scores.withColumn("covered", covered)
