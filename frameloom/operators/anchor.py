"""The anchor detector: an ordered fold over each source, with one frame of look-ahead.

A frame is a candidate if it differs from the group's anchor. It is confirmed by the frame after it, which must come soon,
differ from the anchor too, and agree with the candidate. The fold needs each source in order; a task walks its
sources one after the other and holds five frames at most, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import staged
from ..settings import AnchorSettings
from . import kernels, scans

GROUP_SCHEMA = "source_id string, group_ix int, first_ordinal int, last_ordinal int, rep_ordinal int, start_ticks long, status string, persistence int"
_SCORES = "struct<global_mad:double,max_tile_mad:double,changed_fraction:double>"
#: What opened a group: the differences from the frame before, and from the anchor of the group before.
SCORED_SCHEMA = f"{GROUP_SCHEMA}, adjacent {_SCORES}, anchor {_SCORES}"


@dataclass(frozen=True)
class Metrics:
    """Whole numbers of a comparison; the mean differences are quotients of them."""

    global_sum: int
    valid: int
    changed: int
    max_sum: int
    max_count: int

    def scores(self) -> dict[str, float]:
        return {"global_mad": self.global_sum / (255 * max(1, self.valid)), "max_tile_mad": self.max_sum / (255 * max(1, self.max_count)), "changed_fraction": self.changed / max(1, self.valid)}

    def hit(self, s: AnchorSettings) -> bool:
        if self.changed < s.changed_fraction * self.valid:
            return False
        return self.global_sum >= s.mad * 255 * self.valid or (self.max_count > 0 and self.max_sum >= s.tile_mad * 255 * self.max_count)


def _starts(length: int, tile: int, stride: int) -> np.ndarray:
    side = min(tile, length)
    return np.unique([*range(0, length - side + 1, stride), length - side])


def compare(a: np.ndarray, b: np.ndarray, ok: np.ndarray, s: AnchorSettings) -> Metrics:
    """Differences of two frames, whole and of the tile that differs most; sums of tiles come from running sums."""
    diff = np.where(ok, np.abs(a.astype(np.int64) - b), 0)
    h, w = diff.shape
    th, tw = min(s.tile, h), min(s.tile, w)
    ys, xs = _starts(h, s.tile, s.stride), _starts(w, s.tile, s.stride)

    def tiles(values: np.ndarray) -> np.ndarray:
        upto = np.pad(values.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        rows = upto[ys + th] - upto[ys]
        return (rows[:, xs + tw] - rows[:, xs]).ravel()

    sums, counts = tiles(diff), tiles(ok)
    best = (0, 0)
    for total, n in zip(sums[2 * counts >= th * tw].tolist(), counts[2 * counts >= th * tw].tolist(), strict=True):
        if best[1] == 0 or total * best[1] > best[0] * n:
            best = (total, n)
    return Metrics(int(diff.sum()), int(ok.sum()), int(((diff > s.pixel_delta) & ok).sum()), *best)


@dataclass
class Fold:
    """State of one source: feed() takes frames in order, finish() ends it. Both return the groups that are closed, with scores if ``scored``."""

    settings: AnchorSettings
    anchor: tuple | None = None
    previous: tuple | None = None
    pending: tuple | None = None
    suppressed: tuple | None = None
    first: int = 0
    start_ticks: int = 0
    stable: int = 0
    groups: int = 0
    opened_by: tuple = (None, None)
    scores: tuple = (None, None)
    scored: bool = False
    closed: list = field(default_factory=list)

    def _hit(self, a: tuple, b: tuple) -> bool:
        return compare(a[2], b[2], a[3] & b[3], self.settings).hit(self.settings)

    def feed(self, frame: tuple) -> list:
        """frame: ordinal, ticks, pixels, mask."""
        if self.anchor is None:
            self.anchor = self.previous = frame
            self.first = self.stable = frame[0]
            return self._out()
        if self.pending is not None:
            self._decide(self.pending, frame)
        self.pending = frame
        return self._out()

    def finish(self) -> list:
        if self.anchor is None:
            return []
        if self.pending is not None:
            self._decide(self.pending, None)
        last = self.previous
        self._close(last[0])
        return self._out()

    def _decide(self, now: tuple, after: tuple | None) -> None:
        if self._hit(self.anchor, now):
            if after is None:
                if self.settings.keep_unconfirmed and (self.suppressed is None or self._hit(self.suppressed, now)):
                    self._commit(now, "eof_unconfirmed", 1)
            else:
                soon = 2 * (after[1] - now[1]) <= 3 * (now[1] - self.previous[1])
                if soon and self._hit(self.anchor, after) and not self._hit(now, after):
                    self._commit(now, "confirmed", 2)
                    self.suppressed = None
                else:
                    self.suppressed = now
        elif not self._hit(self.previous, now):
            self.stable, self.suppressed = now[0], None
        self.previous = now

    def _commit(self, frame: tuple, status: str, persistence: int) -> None:
        self._close(self.previous[0])
        self.groups += 1
        if self.scored:
            self.scores = tuple(compare(x[2], frame[2], x[3] & frame[3], self.settings).scores() for x in (self.previous, self.anchor))
        self.anchor, self.first, self.stable = frame, frame[0], frame[0]
        self.start_ticks, self.opened_by = frame[1], (status, persistence)

    def _close(self, last: int) -> None:
        self.closed.append((self.groups, self.first, last, max(self.first, self.stable), self.start_ticks, *self.opened_by, *(self.scores if self.scored else ())))

    def _out(self) -> list:
        done, self.closed = self.closed, []
        return done


    def place(self) -> tuple:
        """What decides the groups to come: two folds of one source that agree in it after the same frame agree from there on."""
        frames = tuple(f and f[0] for f in (self.anchor, self.previous, self.pending, self.suppressed))
        return (*frames, self.first, self.start_ticks, self.stable, self.opened_by, self.scores)


def anchor_groups(frames: DataFrame, settings: AnchorSettings, scored: bool = False) -> DataFrame:
    """Closed groups of each source: first, last and representative frame, where they start, and what opened them (``scored``: by how much).

    ``frames`` has source_id, ordinal, ticks, width, height, px (array) and, if pixels are masked, ok (array).
    """
    ok = F.col("ok") if "ok" in frames.columns else F.lit(None).cast("array<boolean>")
    kernels.small_batches(frames.sparkSession)
    ordered = frames.select("source_id", "ordinal", "ticks", "width", "height", "px", ok.alias("ok")).repartition("source_id").sortWithinPartitions("source_id", "ordinal")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, fold = None, None
        for batch in batches:
            out = []
            for (name,), frame in _frames(batch, ["source_id"]):
                if fold is None or name != source:
                    out += [(source, *g) for g in fold.finish()] if fold else []
                    source, fold = name, Fold(settings, scored=scored)
                out += [(source, *g) for g in fold.feed(frame)]
            yield _batch(out, scored)
        if fold:
            yield _batch([(source, *g) for g in fold.finish()], scored)

    return ordered.mapInArrow(walk, SCORED_SCHEMA if scored else GROUP_SCHEMA)


def _frames(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, tuple]]:
    """The keys and the frame (ordinal, ticks, pixels, mask) of each row."""
    px, lengths = kernels.flat(batch.column("px"))
    at, masks = kernels.begins(lengths).tolist(), batch.column("ok")
    rows = zip(*(batch.column(c).to_pylist() for c in (*keys, "ordinal", "ticks", "height", "width")), strict=True)
    for k, (*own, ordinal, ticks, h, w) in enumerate(rows):
        mask = masks[k].values.to_numpy(zero_copy_only=False).reshape(h, w) if masks[k].is_valid else np.ones((h, w), bool)
        yield tuple(own), (ordinal, ticks, px[at[k] : at[k] + h * w].astype(np.int64).reshape(h, w), mask)


_PIECES = "source_id string, piece long, fed int, merged int, last boolean, " + GROUP_SCHEMA.split(", ", 1)[1]


def speculative_groups(frames: DataFrame, settings: AnchorSettings, piece: int) -> DataFrame:
    """``anchor_groups`` of long sources over many tasks: each source is cut into pieces of ``piece`` ordinals, and a fold is started at each.

    A fold that was started inside a source does not know the anchor, so its first groups may be wrong. The fold of the piece before
    therefore runs on into the piece, beside a second fold that starts there as the piece's own does, until both agree in all
    that decides what comes (as a rule at the first change of page). From that frame on the piece's own groups hold, up to it those of the fold
    before. Every frame goes to two tasks at most. A source in which some fold agrees nowhere in the next piece is folded in one go instead.
    """
    ok = F.col("ok") if "ok" in frames.columns else F.lit(None).cast("array<boolean>")
    kernels.small_batches(frames.sparkSession)
    own = F.floor(F.col("ordinal") / piece)
    rows = frames.select("source_id", F.explode(F.array(own, own - 1)).alias("piece"), own.alias("own"), "ordinal", "ticks", "width", "height", "px", ok.alias("ok"))
    rows = rows.join(frames.select("source_id", own.alias("piece")).distinct(), ["source_id", "piece"], "left_semi")  # no fold runs where no piece begins
    ordered = rows.repartition("source_id", "piece").sortWithinPartitions("source_id", "piece", "ordinal")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fold, beside, merged, fed, out = None, None, None, None, None, []

        def end() -> None:
            """A piece without a next one is the source's last; one that agrees nowhere in the next one is told by its missing ``merged``."""
            if key is not None and merged is None:
                out.extend((*key, fed, None, beside is None, *g) for g in (fold.finish() if beside is None else [(None,) * 7]))

        for batch in batches:
            for (source, number, real), frame in _frames(batch, ["source_id", "piece", "own"]):
                if (source, number) != key:
                    end()
                    key, fold, beside, merged = (source, number), Fold(settings), None, None
                if merged is not None:
                    continue
                fed = frame[0]
                out.extend((*key, fed, None, False, *g) for g in fold.feed(frame))
                if real != number:
                    beside = Fold(settings) if beside is None else beside
                    beside.feed(frame)
                    if fold.place() == beside.place():
                        merged = fed
                        out.append((*key, fed, merged, False, *(None,) * 7))
            yield _pieces(out)
            out = []
        end()
        yield _pieces(out)

    found = staged(ordered.mapInArrow(walk, _PIECES))
    marks = found.where("group_ix IS NULL").select("source_id", "piece", "merged")
    lost = marks.where("merged IS NULL").select("source_id").distinct()
    # Gaps in the ordinals may leave a piece without a next one: then it ends with the source in its fold, though another piece follows.
    pieces = frames.select("source_id", own.alias("piece")).distinct()
    follows = pieces.join(found.where("last").select("source_id", "piece").distinct(), ["source_id", "piece"]).join(pieces.groupBy("source_id").agg(F.max("piece").alias("end")), "source_id")
    lost = lost.union(follows.where("piece < end").select("source_id")).distinct()
    from_ = marks.select("source_id", (F.col("piece") + 1).alias("piece"), F.col("merged").alias("valid_from"))
    valid = found.where("group_ix IS NOT NULL").join(from_, ["source_id", "piece"], "left").where("valid_from IS NULL OR fed > valid_from OR last").join(lost, "source_id", "left_anti")
    names = [f.split()[0] for f in GROUP_SCHEMA.split(", ")]
    numbered = scans.ranks(valid, "first_ordinal", "place").withColumn("group_ix", (F.col("place") - 1).cast("int")).select(*names)
    return numbered.unionByName(anchor_groups(frames.join(lost, "source_id", "left_semi"), settings))


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [f.split() for f in _PIECES.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _batch(rows: list[tuple], scored: bool) -> pa.RecordBatch:
    scores = pa.struct([(n, pa.float64()) for n in ("global_mad", "max_tile_mad", "changed_fraction")])
    kinds = [pa.string(), *[pa.int32()] * 4, pa.int64(), pa.string(), pa.int32(), *[scores] * (2 * scored)]
    names = [f.split()[0] for f in GROUP_SCHEMA.split(", ")] + ["adjacent", "anchor"] * scored
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
