"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Two multinomials over ``buckets`` hashed n-grams are counted over all documents: one of the trusted rows,
one of every row. A document's score is the mean over its n-grams of log p_target / p_raw, hence free of its
length; it is kept if the score reaches ``threshold``. The draw is deterministic: no sampling, no noise.

Defined results: a null or empty text has no words, zero measures, a score of 0 and fails the base rule;
repeated rows are counted and judged once each; with no trusted row (or an empty corpus) both multinomials are
uniform, every score is 0 and only the base rule speaks; columns of the input that bear an output name give way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, bytes_of, documents, free_name, small_batches

#: Size of the hashed n-gram space; what reaches the driver is two numbers a bucket, whatever the corpus.
BUCKETS = 1 << 16
#: Kept from this mean log-likelihood ratio on.
THRESHOLD = -0.1
#: Added to each bucket's count, as a share of a uniform multinomial of this many n-grams a bucket.
SMOOTHING = 5.0
#: The window of the repetition rule.
REPEAT_WINDOW = 8
#: Words of 64 bits in the filter of identifiers: so many rows are broadcast at most, some 16 MB, whatever the number of labels.
FILTER_WORDS = 1 << 17

_SYMBOLS = [ord(c) for c in "#*$%&|<>"]
_SPACES = [9, 10, 11, 12, 13, 32]
_PIECES = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff]+")


def word_ids(words: list[bytes]) -> tuple[np.ndarray, dict[bytes, int]]:
    """Words as numbers in order of first appearance, and the numbers' words."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    return ids, seen


def repeated_words(ids: np.ndarray, window: int = REPEAT_WINDOW) -> int:
    """Words inside windows of ``window`` (a power of two) words that the text holds twice or more.

    Windows are ranked exactly by doubling: ranks of pairs, of pairs of pairs, and so on.
    """
    n = len(ids)
    if n <= window:
        return 0
    ranks, step, counts = ids, 1, None
    while step < window:
        base = int(ranks.max()) + 1
        _, ranks, counts = np.unique(ranks[:-step] * base + ranks[step:], return_inverse=True, return_counts=True)
        if counts.max() < 2:
            return 0
        step *= 2
    starts = np.flatnonzero(counts[ranks] > 1)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edges[:n])))


def measure(text: bytes) -> tuple[int, int, int, int, int, np.ndarray, dict[bytes, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the words as numbers."""
    per_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    code_points = len(text) - int(per_byte[0x80:0xC0].sum())
    ids, seen = word_ids(text.split())
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    return (len(ids), code_points - int(per_byte[_SPACES].sum()), int(per_byte[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeated_words(ids), ids, seen)


def ngram_buckets(ids: np.ndarray, seen: dict[bytes, int], buckets: int) -> np.ndarray:
    """Buckets of the unigrams and bigrams of a text's pieces (letter runs and runs of other signs)."""
    if not len(ids):
        return np.zeros(0, np.int64)
    pieces = [_PIECES.findall(w) for w in seen]
    counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(p) for own in pieces for p in own), np.uint64, int(counts.sum()))
    first = np.cumsum(counts) - counts
    own = counts[ids]
    at = np.repeat(first[ids] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
    one = hashes[at]
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (one[1:] >> np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F)
    two ^= two >> np.uint64(29)
    return (np.concatenate([one, two]) % np.uint64(buckets)).astype(np.int64)


def perhaps(docs: DataFrame, id_col: str, ids: DataFrame, mark: str, words: int = FILTER_WORDS) -> DataFrame:
    """``docs`` with ``mark``: false where the identifier is surely none of ``ids`` (one column), by a bit map of their hashes.

    The map has ``words`` words at most, so it is broadcast at every size; it lets pass all identifiers only where there are
    many times more of them than bits.
    """

    def place(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(64 * words))

    bits = ids.select(place(ids.columns[0]).alias("place")).select((F.col("place") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, CAST(place % 64 AS INT))").alias("bit"))
    table = bits.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    own = F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(`{id_col}`), {64 * words}) % 64 AS INT))")
    joined = docs.join(F.broadcast(table), (place(id_col) / 64).cast("int") == F.col("word"), "left")
    return joined.withColumn(mark, F.coalesce(F.col("bits").bitwiseAND(own) != 0, F.lit(False))).drop("word", "bits")


def count_ngrams(docs: DataFrame, text: str, trusted: str, buckets: int) -> DataFrame:
    """(bucket, raw, target): n-gram counts of all rows and of those with ``trusted`` true.

    Each task adds up its own rows, so the exchange carries at most ``buckets`` rows a task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            marks = batch.column(1).to_pylist()
            for value, mark in zip(bytes_of(batch, batch.schema.names[0]), marks, strict=True):
                got = np.bincount(ngram_buckets(*word_ids(value.split()), buckets), minlength=buckets)
                raw += got
                if mark:
                    target += got
        full = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "raw": raw[full], "target": target[full]})

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text), F.col(trusted)).mapInArrow(count, "bucket int, raw long, target long")
    return rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int, smoothing: float = SMOOTHING) -> np.ndarray:
    """log p_target / p_raw by bucket. Bounded: ``buckets`` rows reach the driver, however large the corpus."""
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for row in counts.collect():
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if not target.sum():
        return np.zeros(buckets)
    # The same prior mass, shaped as the raw corpus, stands behind the target's counts, so rare buckets stay near 0.
    p_raw = (raw + smoothing) / (raw + smoothing).sum()
    prior = smoothing * buckets
    p_target = (target + prior * p_raw) / (target.sum() + prior)
    return np.log(p_target / p_raw)


def quality_rules(docs: DataFrame, trusted_ids: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD, prefix: str = "", back: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed and kept.

    ``trusted_ids`` holds, in its first column, the ids of the rows of the trusted target. ``prefix`` is put
    before each new column's name. ``back`` names the columns of ``docs`` that are returned (all).
    """
    maybe, mark = free_name(docs, "maybe"), free_name(docs, "trusted")
    good = trusted_ids.select(F.col(f"`{trusted_ids.columns[0]}`").alias("good_id")).where("good_id IS NOT NULL").distinct()
    # Labels grow with the documents, so they are never broadcast. Only texts that may be trusted are exchanged to meet them.
    asked = perhaps(docs.select(F.col(id_col), F.col(text_col)), id_col, good, maybe)
    sure = asked.where(~F.col(maybe)).select(F.col(text_col), F.lit(False).alias(mark))
    met = asked.where(F.col(maybe)).join(good.hint("shuffle_hash"), F.col(id_col) == F.col("good_id"), "left").select(F.col(text_col), F.col("good_id").isNotNull().alias(mark))
    ratios = log_ratios(count_ngrams(sure, text_col, mark, buckets).union(count_ngrams(met, text_col, mark, buckets)).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")), buckets)

    def score(texts: list[bytes]) -> list:
        rows = []
        for value in texts:
            *numbers, ids, seen = measure(value)
            found = ngram_buckets(ids, seen, buckets)
            llr = float(ratios[found].mean()) if len(found) else 0.0
            failed = numbers[0] < 20 or 100 * numbers[4] > 30 * numbers[0]
            rows.append((*numbers, llr, failed, not failed and llr >= threshold))
        return list(zip(*rows, strict=True))

    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    fields = [T.StructField(prefix + n, T.LongType()) for n in longs] + [T.StructField(prefix + "llr", T.DoubleType()), T.StructField(prefix + "base_failed", T.BooleanType()), T.StructField(prefix + "kept", T.BooleanType())]
    return add_columns(docs, text_col, fields, score, back)


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trusted target: every row that ``labels`` marks as good."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality_rules(docs, trusted(spark, sf_dir), back=["doc_id"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the rules keep, with the columns of ``docs``: null, empty and short texts fail the base rule and go; an empty table stays empty."""
    prefix = free_name(docs, "rule_") + "_"
    return quality_rules(docs, trusted(spark, sf_dir), prefix=prefix).where(F.col(prefix + "kept")).select(*docs.columns)
