"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's docs.

Defined results: each stage takes nulls in any column, empty and very long texts, repeated rows, further columns and empty
tables as its operator does, and all but the last return the columns of their input; an empty table stays empty
through all stages. The mix repeats documents, so identifiers may occur up to three times in the last two.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from frameloom.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from frameloom.llm.common import shared_folder

STAGES = [
    ("quality rules", quality_rules.stage),
    ("exact dedup", exact_dedup.stage),
    ("simhash near-dedup", simhash.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]

#: SQL can express neither hashed n-gram ratios nor fingerprints, tilts or BPE: the tests compare with brute force.
ORACLE_SQL = None


def folder(spark: SparkSession) -> str:
    """Where stages are written: under the cluster's shared checkpoint folder, or a local session's own where none is set."""
    return f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: ids, token counts and digests of every document that the mix takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
