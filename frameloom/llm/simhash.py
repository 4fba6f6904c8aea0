"""SimHash near-duplicates: tiled exact comparison with numpy exclusive-or and bit counts.

Each text gets a 64-bit fingerprint of its 4-word shingles. Distinct fingerprints are dealt into tiles by the
population counts of their sub-words; a pair of tiles is skipped if those counts differ by more than the radius
in all, since each differing bit moves one count by one at most (with one sub-word this is the plain
population count). The remaining tile pairs are compared exactly, as numpy blocks, one row of packed
fingerprints a tile. From a tile pair a task returns a spanning forest of its links, never all pairs of a
group: the components are the same, and no link between different fingerprints is lost.

The comparison is exact and so quadratic in the number of distinct fingerprints; the counts of three sub-words leave about
a fifth of the tile pairs.

A fingerprint is a node (none, first_id, fp) of the graph of links, in this order. So a component's root holds its smallest
identifier, and nothing has to be looked up by component, however large one is.

Defined results: null and empty texts have the fingerprint zero and are linked like any other; a text of
fewer words than a shingle is one shingle; null identifiers are never a component's smallest unless it has no
other (then the component is null); repeated rows give repeated rows; an empty table gives an empty result;
columns of the input that bear an output name give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, cut_lineage, documents, free_name, join_hot, partitions, small_batches
from .components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints a tile, at most on average: a tile pair is a block of TILE x TILE comparisons.
TILE = 2048
#: Parts of a fingerprint whose bits are counted.
SUBWORDS = 3
_ROWS = 1 << 14


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text, unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    n = max(1, len(words) - shingle + 1)
    last = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _ROWS):
        to = min(n, at + _ROWS)
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[at:to], ends[at + last : to + last], strict=True)), np.uint64, to - at)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` without its texts, and the fingerprint of each row as a (signed) long."""

    def score(texts: list[bytes]) -> list:
        return [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    return add_columns(docs, text_col, [T.StructField(name, T.LongType())], score, back=[c for c in docs.columns if c != text_col])


def linked(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between ``a`` and ``b`` (or within ``a``): positions in their concatenation."""
    both = a if b is None else np.concatenate([a, b])
    other, shift = (a, 0) if b is None else (b, len(a))
    label = np.arange(len(both))
    rows = max(1, (1 << 21) // max(1, len(other)))
    for at in range(0, len(a), rows):
        near = np.bitwise_count(a[at : at + rows, None] ^ other[None, :]) <= radius
        i, j = np.nonzero(near)
        i, j = i + at, j + shift
        if b is None:
            i, j = i[i < j], j[i < j]
        label = _merge(label, i, j)
    child = np.flatnonzero(label != np.arange(len(both)))
    return child, label[child]


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (the least position of a component) after the links i - j are added."""
    while len(i):
        x, y = label[i], label[j]
        differ = x != y
        if not differ.any():
            break
        i, j, x, y = i[differ], j[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def _counts(fp: Column, subwords: int) -> list[Column]:
    """Bits set in each sub-word; the sub-words have 64 / subwords bits, the first ones one more where that leaves a rest."""
    cuts = [-(-64 * k // subwords) for k in range(subwords + 1)]
    return [F.bit_count(F.shiftrightunsigned(fp, low).bitwiseAND(F.lit(-1 if high - low == 64 else (1 << high - low) - 1))) for low, high in zip(cuts, cuts[1:], strict=False)]


def tile_pairs(prints: DataFrame, radius: int, tile: int, subwords: int) -> DataFrame:
    """(fps_a, ids_a, fps_b, ids_b): the nodes of every two tiles that may hold a link; the latter are null where a tile meets itself.

    A node is shipped once for each tile that its tile meets, so it is two numbers: whether its identifier is null is told by that.

    The table of cells (population counts) has at most (64 / subwords + 2) ** subwords rows, whatever the input.
    """
    base = -(-64 // subwords) + 1
    code = sum((c * base**k for k, c in enumerate(_counts(F.col("fp"), subwords))), F.lit(0)).cast("int")
    celled = prints.withColumn("cell", code)
    cells = celled.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    cells = cut_lineage(cells)
    spread = celled.join(F.broadcast(cells), "cell")  # with three sub-words at most 12,167 cells of 8 bytes
    rows = spread.select("cell", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int").alias("part"), F.struct("id", "fp").alias("node"))
    tiles = rows.groupBy("cell", "part").agg(F.collect_list("node").alias("nodes"))
    tiles = tiles.select("cell", "part", F.col("nodes.fp").alias("fps"), F.col("nodes.id").alias("ids"))
    steps = [s for s in product(range(-radius, radius + 1), repeat=subwords) if sum(map(abs, s)) <= radius]
    offsets = [s for s in steps if s > (0,) * subwords]  # each unordered pair of different cells once
    near = F.array(*(F.struct(*(F.lit(x).alias(f"d{k}") for k, x in enumerate(s)), F.lit(sum(x * base**k for k, x in enumerate(s))).alias("step")) for s in offsets))
    digits = [F.floor(F.col("cell") / base**k).cast("int") % base for k in range(subwords)]
    inside = F.lit(True)
    for k, digit in enumerate(digits):
        inside = inside & (digit + F.col(f"near.d{k}")).between(0, base - 1)
    meets = cells.withColumn("near", F.explode(near)).where(inside).select(F.col("cell").alias("cell_a"), F.col("parts").alias("parts_a"), (F.col("cell") + F.col("near.step")).alias("cell_b"))
    meets = meets.join(cells.select(F.col("cell").alias("cell_b"), F.col("parts").alias("parts_b")), "cell_b")
    own = cells.select(F.col("cell").alias("cell_a"), F.col("parts").alias("parts_a"), F.col("cell").alias("cell_b"), F.col("parts").alias("parts_b"))
    plan = meets.select(*own.columns).union(own)
    plan = plan.withColumn("part_a", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1))).withColumn("part_b", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1)))
    plan = plan.where("cell_a <> cell_b OR part_a <= part_b")
    a, b = (tiles.select(*(F.col(c).alias(f"{c}_{side}") for c in ("cell", "part", "fps", "ids"))) for side in "ab")
    same = (F.col("cell_a") == F.col("cell_b")) & (F.col("part_a") == F.col("part_b"))
    met = plan.join(a, ["cell_a", "part_a"]).join(b, ["cell_b", "part_b"])
    return met.select("fps_a", "ids_a", *(F.when(same, F.lit(None)).otherwise(F.col(c)).alias(c) for c in ("fps_b", "ids_b")))


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE, subwords: int = SUBWORDS) -> DataFrame:
    """(u, v): links between the nodes of ``prints`` (none, id, fp), whose fp differ, that span all components of the radius."""
    node = T.StructType([prints.schema[c] for c in ("none", "id", "fp")]).simpleString()

    def nodes(fps: pa.Array, ids: pa.Array, at: np.ndarray) -> pa.Array:
        ids = ids.take(pa.array(at))
        return pa.StructArray.from_arrays([ids.is_null(), ids, fps.take(pa.array(at))], names=["none", "id", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                fps, ids = ([batch.column(c)[k].values for c in cs if batch.column(c)[k].is_valid] for cs in ((0, 2), (1, 3)))
                marks = [x.to_numpy().view(np.uint64) for x in fps]
                child, root = linked(marks[0], marks[1] if len(marks) > 1 else None, radius)
                if len(child):
                    both = pa.concat_arrays(fps), pa.concat_arrays(ids)
                    yield pa.RecordBatch.from_arrays([nodes(*both, child), nodes(*both, root)], names=["u", "v"])

    small_batches(prints.sparkSession)
    pairs = tile_pairs(prints, radius, tile, subwords)
    return pairs.repartition(partitions(prints.sparkSession)).mapInArrow(compare, f"u {node}, v {node}")


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A digest of a row's identifier and text: one key for exchanges, the same for repeated rows only."""
    identifier = F.col(id_col).cast("string")
    return F.md5(F.concat(F.when(identifier.isNull(), "n").otherwise(F.concat(F.lit("i"), identifier)), F.lit("/"), F.coalesce(F.col(text_col), F.lit(""))))


def _rooted(docs: DataFrame, id_col: str, text_col: str, radius: int, tile: int, subwords: int) -> DataFrame:
    """(id_col, text_key, fingerprint, component_id, root) for every row; root, a fingerprint, tells components apart."""
    rows = with_fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _row_key(docs, id_col, text_col).alias("text_key")), "text", "fp")
    rows = cut_lineage(rows)  # some 50 bytes a row: the texts are read once
    prints = rows.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    prints = cut_lineage(prints.select(F.col("id").isNull().alias("none"), "id", "fp", "n"))
    found = components(links(prints.select("none", "id", "fp"), radius, tile, subwords))
    roots = found.select(F.col("node.fp").alias("fp"), F.col("root.id").alias("component_id"), F.col("root.fp").alias("root"))
    grouped = prints.join(roots, "fp", "left")  # a fingerprint is one row on either side
    of_print = grouped.select("fp", "n", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "fp").alias("root"))
    # Copies share a fingerprint: the rows of frequent ones are not exchanged by it.
    told = join_hot(rows, cut_lineage(of_print), "fp", "n", rows.count())
    return told.select(F.col("id").alias(id_col), "text_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def simhash_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile: int = TILE, subwords: int = SUBWORDS) -> DataFrame:
    """(id_col, text_key, fingerprint, component_id) for every row; text_key tells rows apart."""
    return _rooted(docs, id_col, text_col, radius, tile, subwords).drop("root")


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest identifier, once."""
    groups = _rooted(docs, id_col, text_col, radius, TILE, SUBWORDS)
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("text_key"))
    # Not by component_id: components without an identifier share the null, and repeated identifiers may be the smallest of several.
    stay = groups.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.text_key").alias("stay_key"))
    key = free_name(docs, "text_key")
    # Both steps go by the same key, so the texts are exchanged once.
    joined = docs.withColumn(key, _row_key(docs, id_col, text_col)).join(stay.hint("merge"), F.col(key) == F.col("stay_key"))
    return joined.dropDuplicates([key]).select(*docs.columns)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir)).drop("text_key")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, with the columns of ``docs``. All rows without words are one component; an empty table stays empty."""
    return near_dedup(docs)
