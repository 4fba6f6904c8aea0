"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the contracts, as Java and RE2 read it.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Bytes of an Arrow batch, in the JVM as in Python: what a task derives from a text can be several times as large.
SLICE_BYTES = 1 << 20
#: A key with more than a MAX_HOT-th of all rows is hot. So there are fewer than MAX_HOT hot keys at any size of the input.
MAX_HOT = 10_000
WORD_RUN = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a local session without one gets its own.

    On a cluster without the setting there is no folder that all executors see, so that is refused.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder of the session and read it back."""
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir", "") and not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: for wide rows, of which later steps read a few columns."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of SLICE_BYTES at most, whatever their number: a batch is held several times over."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = int(spark.conf.get(name).rstrip("b"))
    if size <= 0 or size > SLICE_BYTES:
        spark.conf.set(name, f"{SLICE_BYTES}b")


def join_hot(left: DataFrame, right: DataFrame, key: str, n: str, total: int, most: int = MAX_HOT) -> DataFrame:
    """``left`` inner-joined with ``right`` on ``key``, where ``right`` holds each key once with its number ``n`` of rows in ``left``.

    The rows of hot keys (more than total / most rows, so fewer than ``most`` keys) meet a broadcast of these keys and are not
    exchanged; all others are joined by exchange. ``left`` is read twice, so it should be cut from its lineage.
    """
    bound = max(1, total // most)
    hot = F.broadcast(right.where(F.col(n) > bound).drop(n))
    cold = right.where(F.col(n) <= bound).drop(n)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(hot, key).unionByName(rest.join(cold, key))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name if ``df`` has such a column already (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` less the columns whose names an operator is about to add: the operator's column wins."""
    lost = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in lost))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def give_back() -> None:
    """At a task's end: memory that Arrow and the C library keep for later goes back, as idle workers stay alive beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def bytes_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null counts as empty."""
    array = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    return [b"" if x is None else x for x in array.to_pylist()]


def add_columns(df: DataFrame, text: str, fields: list[T.StructField], score: Callable[[list[bytes]], list], back: Iterable[str] | None = None) -> DataFrame:
    """Every row of ``df`` and the columns that ``score`` derives from its text, batch by batch.

    ``score`` takes the texts of an Arrow batch and returns one array-like a field. Columns of ``df`` with
    the names of ``fields`` give way. ``back`` names the columns of ``df`` that the rows keep: all by default; where the
    text is not among them it goes to Python only.
    """
    small_batches(df.sparkSession)
    keep = without(df, (f.name for f in fields))
    if text not in keep.columns:
        raise ValueError(f"the text column {text!r} clashes with an output column")
    stay = [c for c in keep.columns if back is None or c in back]
    keep = keep.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*stay, text])))
    places = [keep.columns.index(c) for c in stay]
    schema = T.StructType([*(keep.schema[c] for c in stay), *fields])
    kinds = [to_arrow(f.dataType) for f in fields]
    names = [*stay, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, whole.num_rows * SLICE_BYTES // max(1, whole.nbytes))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                found = score(bytes_of(batch, text))
                arrays = [pa.array(x, type=k) for x, k in zip(found, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in places), *arrays], names=names)
        give_back()

    return keep.mapInArrow(run, schema)


def to_arrow(kind: T.DataType) -> pa.DataType:
    return {
        T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_(),
        T.StringType(): pa.string(), T.BinaryType(): pa.binary(),
    }[kind]


def words_of(text: Column) -> Column:
    """How many words a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RUN)), F.lit(0)).cast("long")
