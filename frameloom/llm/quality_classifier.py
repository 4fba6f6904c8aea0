"""Quality classifier: supervised subword embeddings.

A text's features are its words and their character n-grams, hashed into ``BUCKETS`` rows of a learned table of
vectors. The vectors are averaged over the document; a softmax layer gives the two classes. Both are trained together
by stochastic gradient descent in numpy, on at most ``TRAIN_ROWS`` labelled rows (those with the smallest hashes of their
identifiers) and ``TRAIN_BYTES`` of features, which are counted by Spark. Since the hidden layer is linear, the trained network scores a text
as the mean of one number a feature, which is what the tasks get.

Nothing but the text is an input of a score. Defined results: null and empty texts have no features and get the
network's bias alone; without labelled rows every score is 0.5, with one class only its smoothed share; null
identifiers are not held out and never trained on; repeated rows score alike; an empty table gives an empty
result; columns of the input that bear an output name give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import add_columns, bytes_of, cut_lineage, documents, small_batches

BUCKETS = 1 << 16
GRAMS = (3, 4)
DIMENSIONS = 16
#: The bound of the training sample: labelled rows at most.
TRAIN_ROWS = 2000
#: The bound of what these rows' features take, 8 bytes each: rows beyond it, in the order of the sample, are left out.
TRAIN_BYTES = 128 << 20
EPOCHS = 10
RATE = 0.6
SEED = 7
#: Predicted good from this score on (fixed by the contract).
GOOD_FROM = 0.7
KEPT_WORDS = 400_000


def word_features(word: bytes) -> list[int]:
    """Buckets of a word and of its character n-grams, with marks at its ends."""
    digest, marked = xxhash.xxh3_64_intdigest, b"<" + word + b">"
    found = [digest(word, 1) % BUCKETS]
    try:
        text = marked.decode()
    except UnicodeDecodeError:
        text = marked.decode("latin-1")
    if len(text) == len(marked):  # ASCII: slices of bytes are characters
        return found + [digest(marked[k : k + n]) % BUCKETS for n in GRAMS for k in range(len(marked) - n + 1)]
    return found + [digest(text[k : k + n].encode()) % BUCKETS for n in GRAMS for k in range(len(text) - n + 1)]


def text_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text, at most BUCKETS of them, and how often each occurs."""
    words: dict[bytes, int] = {}
    for w in text.split():
        words[w] = words.get(w, 0) + 1
    total = np.zeros(BUCKETS, np.int64)
    for w, n in words.items():
        np.add.at(total, word_features(w), n)
    own = np.flatnonzero(total)
    return own, total[own]


def held_out(identifier: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(identifier.cast("string"), F.lit(""))), F.lit(4)) == 2


def training_rows(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, bound: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> list:
    """(label, buckets, counts) of at most ``bound`` labelled rows that are not held out, in the order of a hash.

    Rows are taken as long as their features fit in ``most_bytes`` together, so the driver holds no more than that.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    sample = known.orderBy(F.xxhash64(F.col("id"), F.lit(SEED)), "id").limit(bound)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")  # at most `bound` rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [text_features(t) for t in bytes_of(batch, "text")]
            packed = [pa.array([x[c].astype("<u4").tobytes() for x in got], pa.binary()) for c in range(2)]
            keys = [pa.array([f"{xxhash.xxh64_hexdigest(str(i), SEED)} {xxhash.xxh64_hexdigest(t)}" for i, t in zip(batch.column(0).to_pylist(), bytes_of(batch, "text"), strict=True)])]
            yield pa.RecordBatch.from_arrays([*keys, batch.column(2), *packed], names=["key", "label", "buckets", "counts"])

    counted = rows.select("id", "text", "label").mapInArrow(count, "key string, label int, buckets binary, counts binary")
    counted = cut_lineage(counted.orderBy("key").limit(bound))  # a rank over ``bound`` rows at most
    before = F.sum(F.octet_length("buckets") + F.octet_length("counts")).over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    found = counted.withColumn("held", before).where(F.col("held") <= most_bytes).orderBy("key").drop("held").collect()
    return [(r["label"], np.frombuffer(r["buckets"], "<u4").astype(np.int64), np.frombuffer(r["counts"], "<u4").astype(np.float64)) for r in found]


def train(rows: list, epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """What each bucket adds to the logit of class 1 (in the mean over a text's features), and the bias."""
    n, good = len(rows), sum(r[0] for r in rows)
    if not n:
        return np.zeros(BUCKETS), 0.0
    if good in (0, n):
        return np.zeros(BUCKETS), float(np.log((good + 1) / (n - good + 1)))
    draw = np.random.default_rng(SEED)
    vectors = draw.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    softmax, bias = np.zeros((2, DIMENSIONS)), np.zeros(2)
    steps, done = epochs * n, 0
    for _ in range(epochs):
        for k in draw.permutation(n):
            label, own, counts = rows[k]
            now, done = rate * (1 - done / steps), done + 1
            share = counts / max(1.0, counts.sum())
            hidden = share @ vectors[own]
            logits = softmax @ hidden + bias
            miss = np.exp(logits - logits.max())
            miss /= miss.sum()
            miss[label] -= 1
            back = miss @ softmax
            softmax -= now * np.outer(miss, hidden)
            bias -= now * miss * 0.1
            # A feature's step is a share of the text's, as in averaging; scaled up by the number of dimensions.
            vectors[own] -= (now * DIMENSIONS) * share[:, None] * back[None, :]
    return vectors @ (softmax[1] - softmax[0]), float(bias[1] - bias[0])


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", prefix: str = "", back: list[str] | None = None) -> DataFrame:
    """``docs`` (of its columns, ``back``: all) with held_out, score and predicted."""
    weights, bias = train(training_rows(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col))
    kept: dict[bytes, tuple[float, int]] = {}

    def score(texts: list[bytes]) -> list:
        found = []
        for text in texts:
            if len(kept) > KEPT_WORDS:
                kept.clear()
            total, n = 0.0, 0
            for w in text.split():
                own = kept.get(w)
                if own is None:
                    at = word_features(w)
                    own = kept[w] = (float(weights[at].sum()), len(at))
                total += own[0]
                n += own[1]
            found.append(1 / (1 + np.exp(-np.clip(bias + (total / n if n else 0.0), -500, 500))))
        return [np.asarray(found)]

    name = prefix + "score"
    scored = add_columns(docs, text_col, [T.StructField(name, T.DoubleType())], score, back)
    return scored.withColumns({prefix + "held_out": held_out(F.col(id_col)), prefix + "predicted": (F.col(name) >= GOOD_FROM).cast("int")})


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(documents(spark, sf_dir).select("doc_id", "text"), labels, back=["doc_id"]).select("doc_id", "held_out", "score", "predicted")
