"""BPE encoding and decoding: tree concatenation.

A text longer than ``leaf`` characters is halved until the halves fit; the leaves, anywhere in the middle of a
word or not, are encoded in parallel by Spark tasks. Neighbouring encodings are then joined pairwise, up the tree:
a window around the join is encoded anew and grown until it repeats tokens of the left side before the join and
tokens of the right side behind it; the left tokens up to the first agreement, the window's tokens and the right
tokens from the last agreement are the joint encoding. If the window grows to both whole sides, it is the answer.

Why agreement proves equality. Within a pre-token, BPE tokens are the encoding of their text if and only if each
neighbouring pair is the encoding of its own text. Every pair of the joint encoding stands in one of the three
encodings it is made of: the left tokens end, and the window's begin, with the same token at the same place, and so on
the right. Pre-tokens are cut by looking forward from where the last one ended, so two scans that cut at one
place go on alike; inside a run of one kind of signs both end it at the same sign. All this is about the normalized text, and normalization (NFC) does
look across a cut: it orders and composes whole runs of combining marks, however long. So a window begins and ends only where NFC cannot
reach across (before a starter that composes with nothing before it, see ``parted``), covers the whole run that a join may lie in, and agreement is looked for
outside that run only: there both encodings are of the same normalized text. One agreeing token would do then; ``AGREE`` in a row, a quarter window
away from the run, are taken.

Inside a leaf, the library's results are kept by word where a tokenizer's file has the very normalizer and pre-tokenizer
that ``PLAIN_SETUP`` names: it drops white space and never merges, matches or composes across an ASCII blank, so a
text's ids are those of its blank-separated words in turn. Texts of any other tokenizer go through the whole library.

Defined results: a null text counts as empty and has no ids and an empty decoded text; repeated rows give
repeated rows; an empty table gives an empty result; columns of the input that bear an output name give way.
Special tokens' strings in a text are encoded as the library does by default (as special tokens).
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, documents, partitions

#: Characters of the longest text that one task encodes in one go.
LEAF = 32_768
#: Characters on either side of a join that are encoded anew at first.
WINDOW = 256
#: Tokens in a row that must agree on either side of a join.
AGREE = 3
#: Leaves whose tokens a task holds at once.
LEAVES = 32
#: Rows that are the same in identifier and text, as they are repeated at once.
COPIES = 4096
#: Words, and pieces of words, whose ids a Python worker keeps, and the longest of them in bytes: some 60 MB each at most.
KEPT_WORDS = 150_000
KEPT_BYTES = 64

# The setup of the tokenizer whose words can be encoded one by one.
PLAIN_SETUP = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "decoder": None,
}

# That tokenizer's own pre-tokenization, written for words of printable ASCII and Latin-1 letters in lower
# case, and the byte-level alphabet (a byte that prints stands for itself, the others follow from code point 256 on).
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_BYTE_SIGNS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*_PRINTED}))}


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Encoder:
    """A tokenizer file's encoding and decoding, with the results for single words kept.

    A plain word needs no normalization but lower case, so its pre-tokens go straight to the library's BPE
    model, and are kept too: words that differ in case or punctuation share them. Any other word is encoded by the whole
    library, and so is any text of a tokenizer of another setup.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as file:
            setup = json.load(file)
        self.by_word = {k: setup[k] for k in PLAIN_SETUP} == PLAIN_SETUP and setup["model"]["type"] == "BPE" and not setup["model"]["dropout"]
        self.model = self.lib.model
        self.words: dict[bytes, tuple[bytes, str | None]] = {}
        self.pieces: dict[str, tuple[bytes, str]] = {}

    def _piece(self, piece: str) -> tuple[bytes, str]:
        own = piece if piece.isascii() else "".join([_BYTE_SIGNS[b] for b in piece.encode()])
        tokens = self.model.tokenize(own)
        kept = (array("I", [t.id for t in tokens]).tobytes(), " ".join([t.value for t in tokens]))
        if len(piece) <= KEPT_BYTES:
            self.pieces[piece] = kept
        return kept

    def _word(self, word: bytes) -> tuple[bytes, str | None]:
        text = word.decode()
        if _PLAIN.fullmatch(text) and "<|" not in text:
            get = self.pieces.get
            found = [get(p) or self._piece(p) for p in _PIECES.findall(text.lower())]
            kept = found[0] if len(found) == 1 else (b"".join([f[0] for f in found]), " ".join([f[1] for f in found]))
        else:
            ids = self.lib.encode(text, add_special_tokens=False).ids
            kept = (array("I", ids).tobytes(), self.lib.decode(ids, skip_special_tokens=False) if ids else None)
        if len(word) <= KEPT_BYTES:
            self.words[word] = kept
        return kept

    def encode(self, text: bytes) -> tuple[bytes, str]:
        """The ids of a text as little-endian unsigned 32-bit integers, and the decoded text."""
        if not self.by_word:
            ids = self.lib.encode(text.decode(), add_special_tokens=False).ids
            return array("I", ids).tobytes(), self.decode(ids)
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        if len(self.pieces) > KEPT_WORDS:
            self.pieces.clear()
        get = self.words.get
        found = [get(w) or self._word(w) for w in text.split()]
        return b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[1] is not None])

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each one's characters begin and end."""
        got = self.lib.encode(text, add_special_tokens=False)
        at = np.asarray(got.offsets, np.int64).reshape(-1, 2)
        return np.asarray(got.ids, np.int64), at[:, 0], at[:, 1]

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids, skip_special_tokens=False)


@lru_cache(maxsize=1)
def _composing() -> frozenset[str]:
    """Characters that canonical composition may add to one before them: the second ones of all pairs, and Hangul vowels and finals."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(sys.maxunicode + 1))
    return frozenset({chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<"} | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))})


def parted(text: str, at: int) -> bool:
    """Whether NFC treats the text's two sides at ``at`` apart: the sign there is a starter, to the last detail, that joins nothing before it."""
    sign = text[at]
    if sign < "\u0300":
        return True
    first = unicodedata.normalize("NFD", sign)[0]
    return unicodedata.combining(first) == 0 and first not in _composing() and unicodedata.category(sign) != "Cn"


Tokens = tuple[np.ndarray, np.ndarray, np.ndarray]  # ids, starts, ends


def _agreement(x: Tokens, y: Tokens, low: int, high: int) -> list[tuple[int, int]]:
    """Positions (i, j) from which AGREE tokens of x and y are the same, all within low..high."""
    ids_x, from_x, to_x = x
    ids_y, from_y, to_y = y
    found = []
    _, ix, iy = np.intersect1d(from_x, from_y, return_indices=True)
    for i, j in zip(ix.tolist(), iy.tolist(), strict=True):
        a, b = slice(i, i + AGREE), slice(j, j + AGREE)
        if i + AGREE <= len(ids_x) and j + AGREE <= len(ids_y) and from_x[i] >= low and to_x[i + AGREE - 1] <= high:
            if np.array_equal(ids_x[a], ids_y[b]) and np.array_equal(from_x[a], from_y[b]) and np.array_equal(to_x[a], to_y[b]):
                found.append((i, j))
    return found


def join(tokenizer: Encoder, text: str, left: Tokens, right: Tokens, begin: int, at: int, end: int, window: int = WINDOW) -> Tokens:
    """The encoding of text[begin:end] from those of its sides, which meet at ``at``. Offsets are the text's."""
    width = window
    head = tail = at  # what NFC may have changed at the join lies between these
    while head > begin and not parted(text, head):
        head -= 1
    while tail < end and not parted(text, tail):
        tail += 1
    while True:
        low, high = max(begin, head - width), min(end, tail + width)
        if low > begin:  # from the beginning of a token of the left side
            k = int(np.searchsorted(left[1], low, "right")) - 1
            while k >= 0 and not parted(text, int(left[1][k])):
                k -= 1
            low = max(begin, int(left[1][k])) if k >= 0 else begin
        if high < end:
            k = int(np.searchsorted(right[2], high, "left"))
            while k < len(right[2]) and right[2][k] < end and not parted(text, int(right[2][k])):
                k += 1
            high = int(right[2][k]) if k < len(right[2]) else end
        ids, starts, ends = tokenizer.spans(text[low:high])
        mid = (ids, starts + low, ends + low)
        if low == begin and high == end:
            return mid
        # Tokens near the join, or near the window's ends, may differ: agreement is looked for clear of them.
        heads = [(0, 0)] if low == begin else _agreement(left, mid, low, head - window // 4)
        tails = [(len(ids), len(right[0]))] if high == end else _agreement(mid, right, tail + window // 4, high - window // 4)
        if heads and tails:
            i, j = heads[0] if low > begin else (0, 0)
            k, m = tails[-1]
            if j <= k:
                return tuple(np.concatenate([left[c][:i], mid[c][j:k], right[c][m:]]) for c in range(3))  # type: ignore[return-value]
        width *= 2


def join_all(tokenizer: Encoder, text: str, leaves: list[Tokens], starts: list[int]) -> Tokens:
    """Joins up the tree, neighbours first."""
    parts = [(s, e, x) for s, e, x in zip(starts, [*starts[1:], len(text)], leaves, strict=True)]
    while len(parts) > 1:
        paired = []
        for k in range(0, len(parts) - 1, 2):
            (a, m, x), (_, b, y) = parts[k], parts[k + 1]
            paired.append((a, b, join(tokenizer, text, x, y, a, m, b)))
        parts = paired + parts[len(parts) - len(parts) % 2 :]
    return parts[0][2]


def encode_texts(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """(id_col, ids, decoded) of every row: ids are little-endian unsigned 32-bit integers in one binary value.

    Only texts of more than ``leaf`` characters are exchanged: once whole, so that rows that are the same are encoded once, once as leaves, to
    be encoded in parallel, and once with their tokens, to be joined by document. Rows that are the same are counted in their tasks first and
    repeated as they are returned, so no task holds them together.
    """
    kind = docs.schema[id_col].dataType
    docs = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def whole(texts: list[bytes]) -> list:
        tok = encoder(tokenizer)
        return list(zip(*map(tok.encode, texts), strict=True))

    fields = [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    short = add_columns(docs.where(F.length("text") <= leaf), "text", fields, whole, back=["id"])

    long = docs.where(F.length("text") > leaf).groupBy("id", F.md5("text").alias("key")).agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    # Halved, and halved again, until no piece is longer than a leaf: 2 ** depth pieces.
    n = F.length("text")
    count = F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(n / leaf)))).cast("long")
    begin = lambda i: F.floor(i * n / F.col("count")).cast("long")
    spread = long.withColumn("count", count).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    pieces = spread.select("id", "key", "copies", begin(F.col("i")).alias("start"), F.substring(F.col("text"), (begin(F.col("i")) + 1).cast("int"), (begin(F.col("i") + 1) - begin(F.col("i"))).cast("int")).alias("piece"))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(tokenizer)
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, LEAVES):
                batch = whole_batch.slice(at, LEAVES)
                got = [[c.astype("<u4").tobytes() for c in tok.spans(p)] for p in batch.column(4).to_pylist()]
                packed = [pa.array([x[c] for x in got], pa.binary()) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *packed], names=[*batch.schema.names, "ids", "starts", "ends"])

    coded_as = T.StructType([*pieces.schema.fields, *(T.StructField(n, T.BinaryType()) for n in ("ids", "starts", "ends"))])
    coded = pieces.repartition(partitions(docs.sparkSession)).mapInArrow(leaves, coded_as)

    def rejoin(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        tok = encoder(tokenizer)
        own = frame.sort_values("start")
        starts = own["start"].tolist()
        parts = []
        for s, *packed in zip(starts, own["ids"], own["starts"], own["ends"], strict=True):
            ids, first, last = (np.frombuffer(x, "<u4").astype(np.int64) for x in packed)
            parts.append((ids, first + s, last + s))
        ids = join_all(tok, "".join(own["piece"]), parts, starts)[0]
        return pd.DataFrame({"id": own["id"].iloc[:1], "ids": [ids.astype("<u4").tobytes()], "decoded": [tok.decode(ids.tolist())], "copies": own["copies"].iloc[:1]})

    joined_as = T.StructType([T.StructField("id", T.StringType()), *fields, T.StructField("copies", T.LongType())])
    joined = coded.groupBy("id", "key").applyInPandas(rejoin, joined_as)
    # Two steps, so that no array grows with the number of copies.
    some = joined.withColumn("some", F.explode(F.expr(f"sequence(0, (copies - 1) div {COPIES})"))).withColumn("left", F.least(F.lit(COPIES), F.col("copies") - F.col("some") * COPIES))
    joined = some.withColumn("copy", F.explode(F.expr("sequence(1, left)"))).select("id", "ids", "decoded")
    return short.unionByName(joined).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(id_col, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_texts(documents(spark, sf_dir), default_tokenizer()))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: ids and digests by document; null texts have no ids, an empty table gives no rows."""
    encoded = encode_texts(docs, default_tokenizer())
    return encoded.select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
