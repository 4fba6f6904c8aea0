"""Changes between neighbouring frames: by tile, by pair, and by overlapping tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pixels
from ..settings import AnchorSettings, SpatialSettings
from . import kernels


def adjacent_tiles(tiles: DataFrame) -> DataFrame:
    """Each tile with the same tile of the frame before it in its source; a source's first frame has none.

    The window's key is the tile, so a source is spread over as many tasks as it has tiles.
    """
    before = Window.partitionBy("source_id", "ty", "tx").orderBy("ordinal")
    return tiles.withColumn("prev_px", F.lag("px").over(before)).withColumn("prev_ordinal", F.lag("ordinal").over(before)).where("prev_ordinal IS NOT NULL")


def tile_changes(tiles: DataFrame, pixel_delta: int) -> DataFrame:
    """(source_id, ordinal, prev_ordinal, ty, tx, valid, changed): pixels in sight, and those that changed by more than the delta."""
    keys = ["source_id", "ordinal", "prev_ordinal", "ty", "tx"]

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        now, lengths = kernels.flat(batch.column("px"))
        before, ok = kernels.flat(batch.column("prev_px"))[0], kernels.flags(batch.column("ok"))
        moved = (np.abs(now.astype(np.int32) - before) > pixel_delta) & ok
        sums = [pa.array(np.add.reduceat(x, kernels.begins(lengths), dtype=np.int32)) for x in (ok, moved)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *sums], names=[*keys, "valid", "changed"])

    pixels_of = F.octet_length if dict(tiles.dtypes)["px"] == "binary" else F.size
    pairs = adjacent_tiles(tiles).select(*keys, "px", "prev_px", "ok").where(pixels_of("px") > 0)
    return kernels.mapped(pairs, "source_id string, ordinal int, prev_ordinal int, ty int, tx int, valid int, changed int", count).where("valid > 0")


def cells(values: np.ndarray, tile: int) -> np.ndarray:
    """Sums over the tiles of one frame, row by row."""
    h, w = values.shape
    return np.add.reduceat(np.add.reduceat(values, np.arange(0, h, tile), axis=0, dtype=np.int64), np.arange(0, w, tile), axis=1).ravel()


def is_boundary(now: np.ndarray, before: np.ndarray, ok: np.ndarray, settings: SpatialSettings) -> bool:
    """Whether two whole frames lie on different sides of a boundary: the rules of ``tile_changes`` and ``pair_changes`` for one pair."""
    moved = (np.abs(now.astype(np.int32) - before) > settings.pixel_delta) & ok
    valid, changed = cells(ok, settings.tile), cells(moved, settings.tile)
    seen = valid > 0
    if not seen.any() or changed.sum() / valid.sum() < settings.changed_fraction:
        return False
    return np.count_nonzero(changed[seen] / valid[seen] >= settings.cell_changed_fraction) / np.count_nonzero(seen) >= settings.cell_fraction


def tile_changes_in_jvm(tiles: DataFrame, pixel_delta: int) -> DataFrame:
    """The same by lambdas over arrays: for tiles of a few pixels, and to test the kernel."""
    moved = pixels.both(pixels.changed(F.col("px"), F.col("prev_px"), pixel_delta), F.col("ok"))
    return adjacent_tiles(tiles).select("source_id", "ordinal", "prev_ordinal", "ty", "tx", pixels.count_true(F.col("ok")).alias("valid"), pixels.count_true(moved).alias("changed")).where("valid > 0")


def pair_changes(changes: DataFrame, cell_changed_fraction: float) -> DataFrame:
    """Per pair of neighbouring frames: shares of changed pixels and of tiles with enough of them."""
    cell = F.col("changed") / F.col("valid") >= cell_changed_fraction
    return changes.groupBy("source_id", "ordinal").agg(
        F.min("prev_ordinal").alias("prev_ordinal"), F.sum("valid").alias("valid"), F.sum("changed").alias("changed"), F.count_if(cell).alias("changed_cells"), F.count("*").alias("cells")
    ).withColumns({"changed_fraction": F.col("changed") / F.col("valid"), "cell_fraction": F.col("changed_cells") / F.col("cells")})


def spatial_changes(tiles: DataFrame, settings: SpatialSettings) -> DataFrame:
    return pair_changes(tile_changes(tiles, settings.pixel_delta), settings.cell_changed_fraction)


def origins(length: Column, tile: int, stride: int) -> Column:
    """Where overlapping tiles begin along one side: every stride, and one flush with the far border."""
    side = F.least(F.lit(tile), length)
    return F.array_distinct(F.concat(F.sequence(F.lit(0), length - side, F.lit(stride)), F.array(length - side)))


_LOCAL = ("global_sum long", "valid long", "changed long", "max_sum long", "max_count long", "tile_x int", "tile_y int", "eligible long")


def local_changes(pairs: DataFrame, settings: AnchorSettings) -> DataFrame:
    """Per pair of frames (px, other, ok arrays and width, height): whole and largest tile difference.

    Adds global_sum, valid, changed, max_sum, max_count, tile_x, tile_y and eligible; differences stay whole numbers,
    the mean absolute differences are global_sum / (255 valid) and max_sum / (255 max_count). Tiles need half
    their pixels in sight; of equal tiles the first in row-major order counts; without any the place is (0, 0).
    """
    keys = [c for c in pairs.columns if c not in ("px", "other", "ok")]

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        now, lengths = kernels.flat(batch.column("px"))
        before, ok = (kernels.flat(batch.column(c))[0] for c in ("other", "ok"))
        diff = np.abs(now.astype(np.int64) - before) * ok
        rows, at = [], kernels.begins(lengths)
        for begin, n, h, w in zip(at.tolist(), lengths.tolist(), batch.column("height").to_pylist(), batch.column("width").to_pylist(), strict=True):
            own, sight = diff[begin : begin + n].reshape(h, w), ok[begin : begin + n].reshape(h, w)
            rows.append((int(own.sum()), int(sight.sum()), int((own > settings.pixel_delta).sum()), *largest_tile(own, sight, settings.tile, settings.stride)))
        kinds = [pa.int32() if f.endswith(" int") else pa.int64() for f in _LOCAL]
        told = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *told], names=[*keys, *(f.split()[0] for f in _LOCAL)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keys).schema), *_LOCAL])
    return kernels.mapped(pairs.select(*keys, "px", "other", "ok"), schema, measure)


def largest_tile(diff: np.ndarray, ok: np.ndarray, tile: int, stride: int) -> tuple[int, int, int, int, int]:
    """Sum, pixels and place (x, y) of the overlapping tile with the largest mean difference, and how many tiles are eligible.

    Quotients of equal value are the same double, and different ones with under 2 ** 26 pixels a tile are different doubles.
    """
    h, w = diff.shape
    th, tw = min(tile, h), min(tile, w)
    ys, xs = (np.unique([*range(0, n - side + 1, stride), n - side]) for n, side in ((h, th), (w, tw)))

    def sums(values: np.ndarray) -> np.ndarray:
        total = np.zeros((h + 1, w + 1), np.int64)
        total[1:, 1:] = values.cumsum(axis=0, dtype=np.int64).cumsum(axis=1)
        top, low = total[ys], total[ys + th]
        return (low[:, xs + tw] - low[:, xs] - top[:, xs + tw] + top[:, xs]).ravel()

    s, n = sums(diff), sums(ok)
    able = 2 * n >= th * tw
    if not able.any():
        return 0, 0, 0, 0, 0
    best = int(np.argmax(np.where(able, s / np.maximum(n, 1), -1.0)))
    return int(s[best]), int(n[best]), int(xs[best % len(xs)]), int(ys[best // len(xs)]), int(able.sum())


def local_changes_in_jvm(pairs: DataFrame, settings: AnchorSettings) -> DataFrame:
    """The same by lambdas over arrays: for frames of a few pixels, and to test the kernel."""
    keys = [c for c in pairs.columns if c not in ("px", "other", "ok")]
    th, tw = F.least(F.lit(settings.tile), F.col("height")), F.least(F.lit(settings.tile), F.col("width"))
    diff = F.zip_with(F.zip_with("px", "other", lambda a, b: F.abs(a.cast("int") - b.cast("int"))), "ok", lambda d, o: F.when(o, d).otherwise(0))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    whole = pairs.select(*keys, "ok", diff.alias("diff"), pixels.count_true(F.col("ok")).cast("long").alias("valid"))
    whole = whole.withColumns({"global_sum": total(F.col("diff")), "changed": F.size(F.filter("diff", lambda d: d > settings.pixel_delta)).cast("long")})
    cell = lambda y, x: F.struct(
        y.alias("y"), x.alias("x"),
        total(pixels.cut(F.col("diff"), F.col("width"), y, x, th, tw)).alias("s"),
        pixels.count_true(pixels.cut(F.col("ok"), F.col("width"), y, x, th, tw)).cast("long").alias("n"),
    )
    ys, xs = origins(F.col("height"), settings.tile, settings.stride), origins(F.col("width"), settings.tile, settings.stride)
    tiles = F.filter(F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: cell(y, x)))), lambda t: 2 * t["n"] >= th * tw)
    none = F.struct(F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(0).cast("long").alias("s"), F.lit(1).cast("long").alias("n"))
    # a / b > c / d by cross-multiplication, so that ties are exact; row-major order makes the first one win.
    best = F.aggregate(F.slice("tiles", 2, F.greatest(F.size("tiles"), F.lit(1))), F.coalesce(F.get("tiles", F.lit(0)), none), lambda m, t: F.when(t["s"] * m["n"] > m["s"] * t["n"], t).otherwise(m))
    found = whole.withColumn("tiles", tiles).withColumn("best", best)
    return found.select(*keys, "global_sum", "valid", "changed", F.col("best.s").alias("max_sum"), F.when(F.size("tiles") > 0, F.col("best.n")).otherwise(0).cast("long").alias("max_count"), F.col("best.x").alias("tile_x"), F.col("best.y").alias("tile_y"), F.size("tiles").cast("long").alias("eligible"))


def anchor_hit(settings: AnchorSettings) -> Column:
    """Whether the pair's metrics make it a candidate; fractions are compared as products of whole numbers."""
    share = F.col("changed") >= F.lit(settings.changed_fraction) * F.col("valid")
    whole = F.col("global_sum") >= F.lit(settings.mad) * 255 * F.col("valid")
    part = (F.col("max_count") > 0) & (F.col("max_sum") >= F.lit(settings.tile_mad) * 255 * F.col("max_count"))
    return share & (whole | part)
