"""Token counts: delta-maintained rollups with idempotent batch commits.

A change is a signed row: an insert counts a document's tokens up, a delete counts them down, a revision is a delete
of the old count and an insert of the new one. A batch adds up its changes by source, language and tokenizer version
and is committed under its identifier.

A commit writes the sums to a folder of its own attempt and then renames that folder to the batch's name: a rename is done
wholly or not at all, and refuses a name that is taken. So a batch is there whole or not there, of two writers of
one batch one wins, and a batch that is there already is not applied again. Totals are the sums over committed batches
alone, which are additive, so they can be compacted at any time. What a broken attempt leaves behind is never read.

Only per-group sums are stored: a batch reads its own changes and never the documents of earlier ones.

Defined results: a null text has no tokens; null sources, languages and versions are groups of their own; repeated
rows count as often as they occur; an empty batch is committed as such; without a batch there are no totals; groups that
cancel out to no documents stay with zero totals; further columns of the changes are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import default_tokenizer, encoder
from .common import add_columns, cut_lineage, documents, shared_folder, words_of

GROUP = ("source", "lang", "version")
_LEDGER = "source string, lang string, version string, docs long, tokens long, inserted long, deleted long, batch string"


def change(docs: DataFrame, sign: int, version: str, tokens: Column, *, source: str = "source", lang: str = "lang") -> DataFrame:
    """(source, lang, version, tokens, sign): each row of ``docs`` inserted (1) or deleted (-1) with its count under a version."""
    return docs.select(F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.lit(version).alias("version"), tokens.cast("long").alias("tokens"), F.lit(sign).alias("sign"))


def revision(docs: DataFrame, old: tuple[str, Column], new: tuple[str, Column]) -> DataFrame:
    """Counts under one version are taken back, and entered under another."""
    return change(docs, -1, *old).unionByName(change(docs, 1, *new))


class Ledger:
    """The committed batches of a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._store = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self, batch: str) -> bool:
        return self._store.exists(self._at(f"batch={batch}"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add up and write the changes; False, and nothing happens, if the batch is committed already."""
        if self.committed(batch):
            return False
        signed = F.col("sign") * F.col("tokens")
        sums = changes.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("docs"), F.sum(signed).alias("tokens"), F.count_if(F.col("sign") > 0).alias("inserted"), F.count_if(F.col("sign") < 0).alias("deleted"))
        attempt = f"_attempt-{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.path}/{attempt}")
        target = self._at(f"batch={batch}")
        # A rename to a folder that is there would move the attempt into it on some stores, so this is asked for once more.
        if self._store.exists(target) or not self._store.rename(self._at(attempt), target):
            self._store.delete(self._at(attempt), True)
            return False
        return True

    def batches(self) -> DataFrame:
        """The sums of all committed batches, with their batch."""
        names = [x.getPath().toString() for x in self._store.globStatus(self._at("batch=*")) or ()]
        read = self.spark.read.schema(_LEDGER).option("basePath", self.path)
        return read.parquet(*names) if names else self.spark.createDataFrame([], _LEDGER)

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens, inserted, deleted), one row a group."""
        return self.batches().groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in ("docs", "tokens", "inserted", "deleted")))


def encoded_sizes(docs: DataFrame, tokenizer: str, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` without its texts, and how many tokens each has in a tokenizer file; words are kept by worker, whole texts are encoded."""

    def score(texts: list[bytes]) -> list:
        tok = encoder(tokenizer)
        return [[len(tok.encode(t)[0]) // 4 for t in texts]]

    return add_columns(docs, text_col, [T.StructField(name, T.LongType())], score, back=[c for c in docs.columns if c != text_col])


#: Tokenizer versions of the query: words between white space, and the tokens of the public word-level BPE file.
OLD, NEW = "words-1", "word_bpe_49k"


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted under ``words-1``; those labelled toxic are deleted; all others are revised to
    ``word_bpe_49k``; then the first two batches arrive once more, which changes nothing."""
    ledger = Ledger(spark, f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}")
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", "text", words_of(F.col("text")).alias("words"))
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select("doc_id").distinct()
    # The texts are read and counted once; the batches exchange a few numbers a row.
    counted = cut_lineage(encoded_sizes(docs, default_tokenizer(), "encoded"))
    old, new = (OLD, F.col("words")), (NEW, F.col("encoded"))
    insert = change(counted, 1, *old)
    delete = change(counted.join(toxic, "doc_id", "left_semi"), -1, *old)
    revise = revision(counted.join(toxic, "doc_id", "left_anti"), old, new)
    for batch, changes in (("b1-insert", insert), ("b2-delete", delete), ("b3-revise", revise), ("b1-insert", insert), ("b2-delete", delete)):
        ledger.commit(batch, changes)
    return ledger.totals()
