"""Streams over staged files, run to their end turn by turn."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import shared_folder
from .live import rocksdb


def run_in_turns(rows: DataFrame, cuts: list[str], transform: Callable[[DataFrame], DataFrame], mode: str = "append", encoding: str = "avro") -> DataFrame:
    """What a streaming ``transform`` puts out as the rows arrive in turns, one for each predicate of ``cuts``.

    Each turn is written by as many tasks as its rows have partitions, and is one micro-batch; all turns go on from one
    checkpoint, with state in RocksDB, in the ``encoding`` that ``live.rocksdb`` tells of. In update mode a batch's rows replace what an earlier try of the batch wrote; the column ``batch`` tells
    the batches apart.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    for predicate in cuts:
        rows.where(predicate).write.mode("append").parquet(f"{path}/in")
        stream = transform(spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
        out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
        out = out.foreachBatch(keep) if mode == "update" else out.format("parquet").option("path", f"{path}/out")
        with rocksdb(spark, encoding):
            out.start().awaitTermination()
    schema = stream.schema if mode == "append" else stream.schema.add("batch", "long")
    return spark.read.schema(schema).parquet(f"{path}/out")


def latest_rows(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows that a stream put out in update mode, the last of each key."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")
