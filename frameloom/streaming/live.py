"""Live twins of the batch operators: typed state by source, rows of a micro-batch sorted before they are folded.

Each is a stateful processor of ``transformWithStateInPandas``: its state variables have named, typed fields (frames as packed bytes, pages as a map), kept
in RocksDB and written as Avro, so that a field can be added, or the code change, without losing what a checkpoint holds; ``rocksdb`` sets a
session up for that. Nothing is dropped silently: a row that does not come after its source's last one is put out as a reject. A
source is closed by its end row (is_end, with the duration); a pause never closes it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

from ..functions.edit_fold import PageIndex
from ..operators.anchor import Fold
from ..operators.changes import is_boundary
from ..settings import AnchorSettings, SpatialSettings

SEGMENTS = "source_id string, row string, segment_ix int, first_ordinal int, last_ordinal int, start_ticks long, end_ticks long, pts long"
GROUPS = "source_id string, row string, group_ix int, first_ordinal int, last_ordinal int, rep_ordinal int, start_ticks long, status string, persistence int, pts long"
POLICIES = "source_id string, row string, n long, max_gap long, policy string, pts long"
OUTCOMES = "source_id string, seq long, status string, code string, focus string, n_pages int"

#: A frame in the state: pixels as signed 16-bit integers, pixels in sight as bits.
FRAME = "ordinal int, ticks long, height int, width int, px binary, ok binary"
SEGMENT_STATE = "segment_ix int, first int, last int, start_ticks long, origin long, pts long, ended boolean, height int, width int, px binary"
GROUP_STATE = f"anchor struct<{FRAME}>, previous struct<{FRAME}>, pending struct<{FRAME}>, suppressed struct<{FRAME}>, first int, stable int, start_ticks long, groups int, status string, persistence int, origin long, pts long, ended boolean"
POLICY_STATE = "pts long, gap long, n long, ended boolean"
PAGE_STATE = "rep_ordinal int, ticks long, origin string, origin_segment_ix int, derived_segment_ix int, last_edit string, place long"


@contextmanager
def rocksdb(spark: SparkSession, encoding: str = "avro") -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, with a log of changes; the session's settings come back after.

    ``encoding``: Avro for stateful processors; Spark's own aggregates, joins and the like only take ``unsaferow``.
    """
    store = "spark.sql.streaming.stateStore."
    wanted = {
        f"{store}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        f"{store}encodingFormat": encoding,
        f"{store}rocksdb.changelogCheckpointing.enabled": "true",
        f"{store}rocksdb.allowFAllocate": "false",  # some 4 MB set aside for each partition of a state, however small, otherwise
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def names_of(schema: str) -> list[str]:
    """Names of the fields of a schema of plain types."""
    return [f.split()[0] for f in schema.split(", ")]


def sorted_rows(frames: Iterable[pd.DataFrame], order: list[str]) -> list[dict]:
    """The rows of a micro-batch in time order; an end row comes last."""
    whole = pd.concat(list(frames), ignore_index=True)
    return whole.sort_values(order, kind="stable").to_dict("records")


def framed(rows: list[dict], schema: str) -> Iterator[pd.DataFrame]:
    if rows:
        yield pd.DataFrame([{n: r.get(n) for n in names_of(schema)} for r in rows], columns=names_of(schema), dtype=object)


def whole(value) -> int | None:
    return None if pd.isna(value) else int(value)


def sight(row: dict, shape: tuple[int, int]) -> np.ndarray:
    """True but for the pixels inside the row's ``excluded`` rectangle, if it has one."""
    ok = np.ones(shape, bool)
    out = row.get("excluded")
    if out is not None:
        y, x, h, w = (int(out[c]) for c in ("y", "x", "height", "width"))
        ok[y : y + h, x : x + w] = False
    return ok


class Segments(StatefulProcessor):
    def __init__(self, settings: SpatialSettings) -> None:
        self.settings = settings

    def init(self, handle) -> None:
        self.state = handle.getValueState("segment", SEGMENT_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept, names = self.state.get(), names_of(SEGMENT_STATE)
        now = dict(zip(names, kept, strict=True)) if kept else None
        px = np.frombuffer(now["px"], "<i2").reshape(now["height"], now["width"]) if now and now["px"] else None
        out = []
        for row in sorted_rows(rows, ["is_end", "pts"]):
            pts = int(row["pts"])
            if now is not None and (pts <= now["pts"] or now["ended"]):
                out.append({"source_id": key[0], "row": "reject", "pts": pts})
                continue
            if row["is_end"]:
                if now is not None:
                    out.append(self._closed(key[0], now, pts - now["origin"]))
                    now["ended"], px = True, None
                continue
            before, px = px, np.asarray(row["px"], np.int16).reshape(int(row["height"]), int(row["width"]))
            ordinal = int(row["ordinal"])
            if now is None:
                now = dict.fromkeys(names) | {"segment_ix": 0, "first": ordinal, "start_ticks": 0, "origin": pts, "ended": False}
            elif is_boundary(px, before, sight(row, px.shape), self.settings):
                ticks = pts - now["origin"]
                out.append(self._closed(key[0], now, ticks))
                now |= {"segment_ix": now["segment_ix"] + 1, "first": ordinal, "start_ticks": ticks}
            now |= {"pts": pts, "last": ordinal}
        if now is not None:
            shape = (None, None, None) if px is None else (*px.shape, px.astype("<i2").tobytes())
            now |= dict(zip(("height", "width", "px"), shape, strict=True))
            self.state.update(tuple(now[n] for n in names))
        yield from framed(out, SEGMENTS)

    @staticmethod
    def _closed(source: str, now: dict, end: int) -> dict:
        return {"source_id": source, "row": "segment", "segment_ix": now["segment_ix"], "first_ordinal": now["first"], "last_ordinal": now["last"], "start_ticks": now["start_ticks"], "end_ticks": end}

    def close(self) -> None:
        pass


def packed_frame(frame: tuple | None) -> tuple | None:
    if frame is None:
        return None
    ordinal, ticks, px, ok = frame
    return (ordinal, ticks, *px.shape, px.astype("<i2").tobytes(), np.packbits(ok).tobytes())


def unpacked_frame(row: tuple | None) -> tuple | None:
    if row is None:
        return None
    ordinal, ticks, h, w, px, ok = row
    return (ordinal, ticks, np.frombuffer(px, "<i2").astype(np.int64).reshape(h, w), np.unpackbits(np.frombuffer(ok, np.uint8), count=h * w).astype(bool).reshape(h, w))


class AnchorGroups(StatefulProcessor):
    FRAMES = ("anchor", "previous", "pending", "suppressed")
    COUNTS = ("first", "stable", "start_ticks", "groups")

    def __init__(self, settings: AnchorSettings) -> None:
        self.settings = settings

    def init(self, handle) -> None:
        self.state = handle.getValueState("group", GROUP_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fold, origin, last, ended = Fold(self.settings), None, None, False
        kept = self.state.get()
        if kept:
            *values, origin, last, ended = kept
            for name, frame in zip(self.FRAMES, values, strict=False):
                setattr(fold, name, unpacked_frame(frame))
            for name, value in zip(self.COUNTS, values[4:], strict=False):
                setattr(fold, name, value)
            fold.opened_by = tuple(values[8:10])
        out = []
        for row in sorted_rows(rows, ["is_end", "pts"]):
            pts = int(row["pts"])
            if ended or (last is not None and pts <= last):
                out.append({"source_id": key[0], "row": "reject", "pts": pts})
                continue
            if row["is_end"]:
                closed, ended = fold.finish(), True
                fold = Fold(self.settings)
            else:
                origin = pts if origin is None else origin
                px = np.asarray(row["px"], np.int64).reshape(int(row["height"]), int(row["width"]))
                closed, last = fold.feed((int(row["ordinal"]), pts - origin, px, sight(row, px.shape))), pts
            names = ("group_ix", "first_ordinal", "last_ordinal", "rep_ordinal", "start_ticks", "status", "persistence")
            out += [{"source_id": key[0], "row": "group"} | dict(zip(names, g, strict=True)) for g in closed]
        self.state.update((*(packed_frame(getattr(fold, n)) for n in self.FRAMES), *(int(getattr(fold, n)) for n in self.COUNTS), *fold.opened_by, origin, last, ended))
        yield from framed(out, GROUPS)

    def close(self) -> None:
        pass


class GapPolicies(StatefulProcessor):
    def __init__(self, limit_ticks: int) -> None:
        self.limit_ticks = limit_ticks

    def init(self, handle) -> None:
        self.state = handle.getValueState("gap", POLICY_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, gap, n, ended = self.state.get() or (None, 0, 0, False)
        out = []
        for row in sorted_rows(rows, ["is_end", "pts"]):
            pts = int(row["pts"])
            if ended or (last is not None and pts <= last):
                out.append({"source_id": key[0], "row": "reject", "pts": pts})
                continue
            gap = max(gap, pts - (last or 0))
            if row["is_end"]:
                ended = True
                out.append({"source_id": key[0], "row": "policy", "n": n, "max_gap": gap, "policy": "half" if gap < self.limit_ticks else "all"})
            else:
                last, n = pts, n + 1
        self.state.update((last, gap, n, ended))
        yield from framed(out, POLICIES)

    def close(self) -> None:
        pass


class Edits(StatefulProcessor):
    """Pages are a map by identifier; a batch reads its source's pages once and writes back those that its edits touched."""

    def init(self, handle) -> None:
        self.pages = handle.getMapState("pages", "page_id string", PAGE_STATE)
        self.last = handle.getValueState("last", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = names_of(PAGE_STATE)
        index = PageIndex({"page_id": k[0]} | dict(zip(names, v, strict=True)) for k, v in self.pages.iterator())
        kept = self.last.get()
        last, out = kept[0] if kept else None, []
        for row in sorted_rows(rows, ["seq", "to_ticks"]):
            edit = row | {c: whole(row[c]) for c in ("seq", "to_ordinal", "to_ticks", "to_segment_ix")} | {"page_ids": None if row["page_ids"] is None else list(row["page_ids"])}
            if last is not None and edit["seq"] <= last:
                out.append({"source_id": key[0], "seq": edit["seq"], "status": "rejected", "code": "OutOfOrder", "focus": None, "n_pages": len(index)})
                continue
            if edit["kind"] == "load":
                index.load({"page_id": edit["new_id"], "rep_ordinal": edit["to_ordinal"], "ticks": edit["to_ticks"], "derived_segment_ix": edit["to_segment_ix"]})
                continue
            last = edit["seq"]
            status, code, focus = index.apply(edit)
            out.append({"source_id": key[0], "seq": last, "status": status, "code": code, "focus": focus, "n_pages": len(index)})
        for page_id in index.touched:
            page = index.page(page_id)
            if page is None:
                self.pages.removeKey((page_id,))
            else:
                self.pages.updateValue((page_id,), tuple(page.get(n) for n in names))
        if last is not None:
            self.last.update((last,))
        yield from framed(out, OUTCOMES)

    def close(self) -> None:
        pass


def _keyed(stream: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    return stream.groupBy("source_id").transformWithStateInPandas(processor, schema, "append", "none")


def live_segments(stream: DataFrame, settings: SpatialSettings) -> DataFrame:
    """Closed segments (row = segment) and rejects (row = reject) of a stream of frames.

    ``stream``: source_id, ordinal, pts, width, height, px (array), is_end and, if pixels are masked, excluded. An end row
    carries the end of the source as pts.
    """
    return _keyed(stream, Segments(settings), SEGMENTS)


def live_anchor_groups(stream: DataFrame, settings: AnchorSettings) -> DataFrame:
    """The anchor detector on such a stream: a candidate is decided when the next frame, or the end row, arrives."""
    return _keyed(stream, AnchorGroups(settings), GROUPS)


def live_gap_policy(stream: DataFrame, limit_ticks: int) -> DataFrame:
    """The gap policy of a growing packet stream (source_id, pts from 0, is_end): put out once a source ends."""
    return _keyed(stream, GapPolicies(limit_ticks), POLICIES)


def live_edits(stream: DataFrame) -> DataFrame:
    """A log of resolved edits on a stream, the pages in the state; rows of kind ``load`` bring the first pages.

    ``stream``: source_id, seq, kind, page_ids, to_ordinal, to_ticks, to_segment_ix, new_id. Puts out what each edit did.
    An edit that does not come after its source's last one, or pages that come after an edit, are rejected as ``OutOfOrder``.
    """
    return _keyed(stream, Edits(), OUTCOMES)
