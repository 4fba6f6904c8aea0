"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

Documents are dealt into blocks. A task rolls the windows of its block into two polynomial hashes each, keeps the
distinct ones in order, and sends them to buckets (ranges of the first hash) as packed, difference-coded rows: some
ten bytes a window, with at most one entry a block for a passage that is everywhere. A bucket's task merges what all
blocks sent, and answers each block with one bit a window: whether the same window starts anywhere else. The
blocks then merge repeated windows into maximal removal intervals.

A window's key has 96 bits: 64 of one hash and 32 of another, over two 61-bit fields, each with word values of its own
(64-bit hashes of the word under two keys). Among N windows of which none repeats, N * N / 2 ** 97 chance pairs are to be
expected: 4e-10 for the 8e9 windows of 30 GB, 2e-3 for those of 100 TB.

A row is a block's part of a bucket. Once there are more of them than windows in a block, rows hold a window or two each and
cost some seven times as many bytes: the growth stays linear in the input.

Defined results: null and empty texts have no words; a text shorter than a window has none to remove; repeated rows
are repeats of each other and lose every window; an empty table gives an empty result; columns of the
input that bear an output name give way.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, partitions, small_batches

#: Words in a window.
WINDOW = 35
#: Text bytes of a block, on average; a block is what one call of a task holds.
BLOCK_BYTES = 4 << 20
#: Packed bytes of a bucket, on average, over all blocks.
BUCKET_BYTES = 32 << 20
#: Windows that are rolled at once: what they need stays in a core's cache.
STRETCH = 1 << 14

# The field 2 ** 61 - 1, two multipliers, and two keys of words' hashes.
_FIELD = (1 << 61) - 1
_MULTIPLIERS = (0x1B873593CC9E2D51 % _FIELD, 0x0B4B82E39D1F6E35 % _FIELD)
_WORD_KEYS = ("frameloom-word-1", "frameloom-word-2")


def _times(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """a * b modulo 2 ** 61 - 1, for values below it."""
    low32, field = np.uint64(0xFFFFFFFF), np.uint64(_FIELD)
    b = np.asarray(b, np.uint64)
    al, ah, bl, bh = a & low32, a >> np.uint64(32), b & low32, b >> np.uint64(32)
    low, mid, high = al * bl, al * bh + ah * bl, ah * bh
    # mid < 2 ** 62; 2 ** 64 = 8 and 2 ** 61 = 1 in the field.
    total = (low & field) + (low >> np.uint64(61)) + ((mid << np.uint64(32)) & field) + (mid >> np.uint64(29)) + (high << np.uint64(3))
    return _reduced(total)


def _reduced(total: np.ndarray) -> np.ndarray:
    field = np.uint64(_FIELD)
    total = (total & field) + (total >> np.uint64(61))
    return np.minimum(total, total - field)  # below the field the difference wraps around, far above


@lru_cache(maxsize=16)
def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, ..., base ** (n - 1), by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, _times(out, pow(base, len(out), _FIELD))])
    return out[:n]


def rolled(values: np.ndarray, window: int, multiplier: int) -> np.ndarray:
    """Rabin-Karp hashes of every window, the sum of values[i + j] * multiplier ** (window - 1 - j).

    Within a stretch word k is divided by multiplier ** k, so that a window is a difference of two running sums, multiplied by
    the power of its last word. The sums are kept for the lower 32 and the upper 29 bits apart and do not overflow.
    """
    n = len(values) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    longest = min(STRETCH, n) + window - 1
    falling, rising = _powers(pow(multiplier, -1, _FIELD), longest), _powers(multiplier, longest)
    low32, field = np.uint64(0xFFFFFFFF), np.uint64(_FIELD)
    out = np.empty(n, np.uint64)
    for at in range(0, n, STRETCH):
        words = values[at : min(at + STRETCH, n) + window - 1]
        scaled = _times(words, falling[: len(words)])
        sums = np.zeros((2, len(words) + 1), np.uint64)
        np.cumsum(scaled & low32, out=sums[0, 1:])
        np.cumsum(scaled >> np.uint64(32), out=sums[1, 1:])
        low, high = sums[:, window:] - sums[:, :-window]
        total = (low & field) + (low >> np.uint64(61)) + ((high << np.uint64(32)) & field) + (high >> np.uint64(29))
        out[at : at + STRETCH] = _times(_reduced(total), rising[window - 1 : len(words)])
    return out


class _WordValues:
    """Two field elements for each word: its SipHash under one key and under another."""

    def of(self, texts: list[list[bytes]], n: int) -> list[np.ndarray]:
        """For all words of the texts in turn, the elements of one field and of the other."""
        words = np.fromiter(chain.from_iterable(texts), object, n)
        return [_reduced(pd.util.hash_array(words, hash_key=key, categorize=False)) for key in _WORD_KEYS]


def window_keys(texts: list[list[bytes]], window: int, values: _WordValues) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First hash (64 bits), check (32 bits) and document of every window of the texts (as words)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    one, two = (rolled(x, window, m) for x, m in zip(values.of(texts, int(lengths.sum())), _MULTIPLIERS, strict=True))
    doc = np.repeat(np.arange(len(texts)), lengths)
    if not len(one):
        return one, two.astype(np.uint32), doc[:0]
    inside = doc[: len(one)] == doc[window - 1 :]
    one, two, doc = one[inside], two[inside], doc[: len(one)][inside]
    # 61 bits of the first field element and 35 of the second: 64 + 32.
    first = one << np.uint64(3) | two & np.uint64(7)
    return first, (two >> np.uint64(3)).astype(np.uint32), doc


def distinct_keys(first: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the windows, and for each sorted one the number of its distinct key."""
    order = np.argsort(first)
    a, b = first[order], check[order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    if (~new[1:] & (b[1:] != b[:-1])).any():  # two windows that only the check tells apart: once in 1e6 buckets
        order = np.lexsort((check, first))
        a, b = first[order], check[order]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.cumsum(new) - 1


def pack(first: np.ndarray, check: np.ndarray, again: np.ndarray) -> bytes:
    """Sorted keys as bytes: count, start, width, the differences in ``width`` bytes each, the checks, a bit each for again."""
    gaps = np.diff(first, prepend=first[:1])
    top = int(gaps.max()) if len(gaps) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    head = np.array([len(first), first[0], width], "<u8").tobytes()
    body = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return head + np.ascontiguousarray(body).tobytes() + check.astype("<u4").tobytes() + np.packbits(again).tobytes()


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, start, width = (int(x) for x in np.frombuffer(packed, "<u8", 3))
    at = 24
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(packed, np.uint8, n * width, at).reshape(n, width)
    at += n * width
    check = np.frombuffer(packed, "<u4", n, at)
    again = np.unpackbits(np.frombuffer(packed, np.uint8, offset=at + 4 * n), count=n).astype(bool)
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64) + np.uint64(start), check, again


def _block_words(frame: pd.DataFrame) -> tuple[pd.DataFrame, list[list[bytes]]]:
    """A block's rows in an order that its contents alone decide, and their words."""
    frame = frame.sort_values(["id", "text"], kind="stable", na_position="last", ignore_index=True)
    return frame, [t.encode().split() for t in frame["text"]]


def covered(lengths: list[int], doc: np.ndarray, place: np.ndarray, window: int) -> list[np.ndarray]:
    """Per document, a mask of the words inside the windows (document, start): the union of maximal intervals."""
    starts = np.cumsum([0, *lengths])
    edges = np.zeros(int(starts[-1]) + 1, np.int64)
    at = starts[doc] + place
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    mask = np.cumsum(edges)[:-1] > 0
    return [mask[s:e] for s, e in zip(starts[:-1], starts[1:], strict=True)]


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id_col, n_words, n_removed, kept_text, removed) of every row; removed lists [start, end) word intervals."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A row is a block's part of a bucket: both numbers follow the input, and fewer but fuller rows cost less.
    blocks = max(2 * partitions(spark), -(-size // block_bytes))
    buckets = max(partitions(spark), -(-size * 2 // bucket_bytes))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("text", "id"), F.lit(blocks)).cast("long"))
    by_block = dealt.groupBy("block")

    def keys_of(words: list[list[bytes]]) -> tuple:
        first, check, doc = window_keys(words, window, _WordValues())
        order, number = distinct_keys(first, check)
        heads = np.flatnonzero(np.diff(number, prepend=-1))
        counts = np.diff(heads, append=len(number))
        return first, check, doc, order, number, heads, counts

    def send(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        _, words = _block_words(frame)
        first, check, _, order, _, heads, counts = keys_of(words)
        first, check, again = first[order][heads], check[order][heads], counts > 1
        # Ranges of the first hash, so a block's buckets follow each other in the order of its keys.
        bucket = ((first >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = [*cuts[1:].tolist(), len(bucket)][: len(cuts)]  # none if no text has a window
        rows = [(int(bucket[s]), key[0], pack(first[s:e], check[s:e], again[s:e])) for s, e in zip(cuts.tolist(), ends, strict=True)]
        return pd.DataFrame(rows, columns=["bucket", "block", "packed"])

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(p) for p in frame["packed"]]
        lengths = [len(x[0]) for x in parts]
        first, check, again = (np.concatenate([x[c] for x in parts]) for c in range(3))
        order, number = distinct_keys(first, check)
        times = np.bincount(number, weights=1 + again[order])
        repeated = np.zeros(len(first), bool)
        repeated[order] = times[number] > 1
        ends = np.cumsum(lengths)
        bits = [np.packbits(repeated[e - n : e]).tobytes() for e, n in zip(ends, lengths, strict=True)]
        return pd.DataFrame({"block": frame["block"], "bucket": frame["bucket"], "n": lengths, "bits": bits})

    sent = by_block.applyInPandas(send, "bucket long, block long, packed binary")
    answers = sent.groupBy("bucket").applyInPandas(count, "block long, bucket long, n long, bits binary")

    def finish(frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        frame, words = _block_words(frame)
        told = told.sort_values("bucket")
        flags = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for n, b in zip(told["n"], told["bits"], strict=True)]
        _, _, doc, order, number, _, _ = keys_of(words)
        lengths = [len(w) for w in words]
        repeated = np.zeros(len(doc), bool)
        if len(doc):
            repeated[order] = np.concatenate(flags)[number]
        sizes = np.maximum(0, np.asarray(lengths, np.int64) - window + 1)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        masks = covered(lengths, doc[repeated], place[repeated], window)
        texts, cut = [], []
        for own, mask in zip(words, masks, strict=True):
            hit = mask.any()
            texts.append(b" ".join(compress(own, (~mask).tolist()) if hit else own).decode())
            cut.append(np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist() if hit else [])
        return pd.DataFrame({"id": frame["id"], "n_words": lengths, "n_removed": [int(m.sum()) for m in masks], "kept_text": texts, "removed": cut})

    out = T.StructType([T.StructField("id", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("removed", T.ArrayType(T.ArrayType(T.LongType())))])
    return by_block.cogroup(answers.groupBy("block")).applyInPandas(finish, out).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("removed").cast("long").alias("n_intervals"))


OP6_SQL = r"""
WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
r AS (SELECT row_number() OVER () AS rid, doc_id, ws, len(ws) AS n FROM w),
k AS (SELECT rid, unnest(range(1, n - 33)) AS i FROM r WHERE n >= 35),
h AS (SELECT k.rid, k.i, array_to_string(r.ws[k.i:k.i + 34], ' ') AS s FROM k JOIN r USING (rid)),
d AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY s) AS c FROM h) WHERE c > 1),
c AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM d),
x AS (SELECT rid, unnest(ws) AS word, unnest(range(1, n + 1)) AS p FROM r),
l AS (SELECT x.rid, string_agg(word, ' ' ORDER BY x.p) AS kept, count(*) AS m FROM x ANTI JOIN c ON x.rid = c.rid AND x.p = c.p GROUP BY x.rid),
g AS (SELECT rid, count(*) AS n_intervals FROM (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS q FROM c) WHERE q IS NULL OR q < p - 1 GROUP BY rid)
SELECT doc_id, n AS n_words, n - coalesce(m, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_intervals, 0) AS n_intervals
FROM r LEFT JOIN l USING (rid) LEFT JOIN g USING (rid)
"""
