"""Ranked lexical search: accumulator-limited, term at a time, over an index that is partitioned by document.

Every document is read once, into shards: a shard holds its documents' identifiers and lengths and, for each term that some item
may ask for, the places and frequencies of the documents with it. Whether an item may ask for a term is told by a bit map of term hashes of a
fixed size; it lets some other terms pass, which costs room but changes nothing, since terms are compared as text from then on.

Items are searched in packs of at most ``PACK_BYTES``, each against all shards. In a shard, an item's terms are walked from the rarest (by
document frequency in the whole corpus) to the most frequent. A document that a term meets first gets an accumulator, until the bounds of the
terms still to come (weight, times repeats in the item, times the largest share that the term has in the shard) add up to less than the k-th
largest partial score: a document without an accumulator cannot reach the first k any more, not even by a tie. From then on only existing
accumulators are added to, exactly. Each shard gives its first k an item; the first k of these are the answer. Documents are never exchanged.

A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), the rest is integer arithmetic; 75 * n * N has to fit a long (n words in one
of N documents).

Defined results: null and empty texts have no terms, are in no result and do not count; ties go to the smaller identifier, a null
identifier after all others; repeated rows of documents are documents of their own (in an order that their content leaves open, so
the result does not show it); each row of items is ranked for itself, repeated ones too; items without terms, or with no term in any document, have no rows; an
empty table gives an empty result; other columns of both tables are ignored, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import documents, small_batches, written

K = 10
#: Bits of the map of the terms that items may ask for: 1 MB, whatever the number of items.
FILTER_BITS = 1 << 23
#: Bytes of text that a shard is made of, one document at least.
SHARD_BYTES = 16 << 20
#: Bytes of items (their terms, with 16 bytes for each) that are searched at once, one item at least.
PACK_BYTES = 4 << 20
SCALE, SATURATION, BASE, SLOPE = 1_000_000_000, 8, 25, 75

# Bytes that belong to terms (ASCII letters and digits, and all of other characters), A-Z lower-cased; others part terms.
_TERM_BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The terms of a column of texts: how many each text has, the distinct ones, and all of them in turn as places among these."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    first, last = texts.offset, texts.offset + len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[first : last + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    plain = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer((ends - ends[0]).astype(np.int32).tobytes()), pa.py_buffer(_TERM_BYTES[data].tobytes())])
    split = pc.ascii_split_whitespace(plain)
    coded = pc.dictionary_encode(split.flatten())
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    blank = pc.index(coded.dictionary, "").as_py()
    if blank >= 0:  # texts that begin or end with a parting sign
        owner, at = owner[at != blank], at[at != blank]
    return np.bincount(owner, minlength=len(texts)), coded.dictionary, at


def places(terms: pa.Array, bits: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) % bits for t in terms.cast(pa.binary()).to_pylist()), np.int64, len(terms))


def term_map(items: DataFrame, text_col: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit for each hash of a term of the items; at most bits / 64 words are summed up by Spark and sent to the driver."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, bool)
        for batch in batches:
            seen[places(terms_of(batch.column(0))[1], bits)] = True
        words = np.packbits(seen, bitorder="little").view("<i8")
        full = np.flatnonzero(words)
        yield pa.RecordBatch.from_pydict({"word": pa.array(full, pa.int32()), "bits": words[full]})

    found = items.select(text_col).mapInArrow(mark, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    words = np.zeros(bits // 64, "<i8")
    for r in found.collect():
        words[r["word"]] = r["bits"]
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)


def packed(values: np.ndarray) -> bytes:
    return values.astype("<u4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4").astype(np.int64)


def index(docs: DataFrame, wanted: np.ndarray, *, id_col: str, text_col: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Shards (ids, lengths, terms, documents with each term, their places, their frequencies), a row each; documents without terms are left out."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType
    asked = spark.sparkContext.broadcast(np.packbits(wanted))  # FILTER_BITS bits

    def shard(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        texts = table.column(1).combine_chunks()
        n, terms, at = terms_of(texts)
        ok = np.unpackbits(asked.value).view(bool)[places(terms, FILTER_BITS)] if len(terms) else np.zeros(0, bool)
        owner = np.repeat(np.arange(len(n)), n)
        own = np.flatnonzero(n)
        short = np.cumsum(n > 0) - 1  # the place of a document among those with terms
        keep = ok[at]
        pairs, tf = np.unique(at[keep] * max(1, len(own)) + short[owner[keep]], return_counts=True)
        term, doc = np.divmod(pairs, max(1, len(own)))
        used, df = np.unique(term, return_counts=True)
        row = [[x] for x in (table.column(0).combine_chunks().take(pa.array(own)).to_pylist(), packed(n[own]), terms.take(pa.array(used)).to_pylist(), packed(df), packed(doc), packed(tf))]
        kinds = [pa.list_(table.schema[0].type), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["ids", "lengths", "terms", "dfs", "docs", "tfs"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= shard_bytes:
                yield shard(held)
                held, size = [], 0
        if held:
            yield shard(held)

    fields = [T.StructField("ids", T.ArrayType(kind)), T.StructField("lengths", T.BinaryType()), T.StructField("terms", T.ArrayType(T.StringType())), *(T.StructField(n, T.BinaryType()) for n in ("dfs", "docs", "tfs"))]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(shards, T.StructType(fields))


def packs(items: DataFrame, *, item_col: str, text_col: str, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """Packs of items as rows: their identifiers and, by item, distinct terms and how often each occurs in it."""
    kind = items.schema[item_col].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def row() -> pa.RecordBatch:
            ids, terms, times = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([list(ids)], pa.list_(first)), pa.array([list(terms)], pa.list_(pa.list_(pa.string()))), pa.array([list(times)], pa.list_(pa.list_(pa.int64())))], names=["items", "terms", "times"])

        for batch in batches:
            first = batch.schema[0].type
            for k, item in enumerate(batch.column(0).to_pylist()):
                _, terms, at = terms_of(batch.column(1).slice(k, 1))
                own, times = np.unique(at, return_counts=True)
                terms = terms.take(pa.array(own))
                if held and size + terms.nbytes + 16 * len(own) > pack_bytes:
                    yield row()
                    held, size = [], 0
                held.append((item, terms.to_pylist(), times.tolist()))
                size += terms.nbytes + 16 * len(own)
        if held:
            yield row()

    fields = [T.StructField("items", T.ArrayType(kind)), T.StructField("terms", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("times", T.ArrayType(T.ArrayType(T.LongType())))]
    return items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).mapInArrow(pack, T.StructType(fields))


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def search_shard(terms: dict[str, int], slices: list[slice], docs: np.ndarray, shares: np.ndarray, query: list[tuple[str, int]], size: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of documents that may be among the first ``k`` of a shard, and how many accumulators were made.

    ``query`` holds terms, the rarest first, and what one unit of share is worth.
    """
    steps = [(slices[terms[t]], worth) for t, worth in query if t in terms]
    bounds = [int(shares[own].max()) * worth for own, worth in steps]
    ahead = np.cumsum(bounds[::-1])[::-1].tolist() if bounds else []
    score, live, made, limited = np.zeros(size, np.int64), np.zeros(size, bool), 0, False
    for (own, worth), rest in zip(steps, ahead, strict=True):
        at, add = docs[own], shares[own] * worth
        if not limited and made >= k:
            have = score[live]
            limited = rest < np.partition(have, len(have) - k)[len(have) - k]
        if limited:
            known = live[at]
            score[at[known]] += add[known]
        else:
            score[at] += add
            live[at] = True
            made = int(np.count_nonzero(live))
    found = np.flatnonzero(score > 0)
    return found, score[found], made


def ranked_search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = K, shard_bytes: int = SHARD_BYTES, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """(item_col, rank, id_col, score): the ``k`` best documents of each item."""
    spark = docs.sparkSession
    item_kind, id_kind = items.schema[item_col].dataType, docs.schema[id_col].dataType
    shards = written(index(docs, term_map(items, item_text), id_col=id_col, text_col=text_col, shard_bytes=shard_bytes))
    questions = written(packs(items, item_col=item_col, text_col=item_text, pack_bytes=pack_bytes))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [unpacked(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"n": [len(x) for x in lengths], "words": [int(x.sum()) for x in lengths]})

    total = shards.select("lengths").mapInArrow(sizes, "n long, words long").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    n_docs, n_words = total["n"] or 0, total["words"] or 0
    found = None
    for number, pack in enumerate(questions.toLocalIterator()):  # one bounded pack at a time
        own = spark.sparkContext.broadcast(sorted({t for terms in pack["terms"] for t in terms}))

        def frequencies(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            at = {t: k for k, t in enumerate(own.value)}
            total = np.zeros(len(at), np.int64)
            for batch in batches:
                for terms, dfs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    known = [(at[t], j) for j, t in enumerate(terms) if t in at]
                    if known:
                        a, j = np.array(known).T
                        total[a] += unpacked(dfs)[j]
            full = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"term": pa.array(full, pa.int32()), "df": total[full]})

        counted = shards.select("terms", "dfs").mapInArrow(frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # terms of one pack
        df = {own.value[r["term"]]: r["df"] for r in counted}
        asked = []
        for terms, times in zip(pack["terms"], pack["times"], strict=True):
            known = sorted((df[t], t, times[j]) for j, t in enumerate(terms) if t in df)
            asked.append([(t, m * weight(n_docs, f)) for f, t, m in known])
        told = spark.sparkContext.broadcast((pack["items"], asked))

        def search(batches: Iterator[pa.RecordBatch], told=told, number=number) -> Iterator[pa.RecordBatch]:
            names, asked = told.value
            for batch in batches:
                for ids, lengths, terms, dfs, at, tfs in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                    n, at, tf, ends = unpacked(lengths), unpacked(at), unpacked(tfs), np.cumsum(unpacked(dfs))
                    slices = [slice(e - f, e) for e, f in zip(ends.tolist(), unpacked(dfs).tolist(), strict=True)]
                    shares = SCALE * tf // (1000 * tf + SATURATION * (BASE + SLOPE * n * n_docs // n_words)[at])
                    order = sorted(range(len(ids)), key=lambda j: (ids[j] is None, 0 if ids[j] is None else ids[j]))
                    by_id = np.empty(len(ids), np.int64)
                    by_id[order] = np.arange(len(ids))
                    where = {t: j for j, t in enumerate(terms)}
                    rows = []
                    for q, query in enumerate(asked):
                        place, score, _ = search_shard(where, slices, at, shares, query, len(ids), k)
                        if len(place) > k:
                            best = score >= np.partition(score, len(score) - k)[len(score) - k]
                            place, score = place[best], score[best]
                        first = np.lexsort((by_id[place], -score))[:k]
                        rows += [(number, q, names[q], ids[p], s) for p, s in zip(place[first].tolist(), score[first].tolist(), strict=True)]
                    kinds = [pa.int32(), pa.int32(), item_arrow, id_arrow, pa.int64()]
                    columns = list(zip(*rows, strict=True)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, kinds, strict=True)], names=["pack", "place", "item", "id", "score"])

        item_arrow, id_arrow = (_arrow(x) for x in (item_kind, id_kind))
        fields = [T.StructField("pack", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("item", item_kind), T.StructField("id", id_kind), T.StructField("score", T.LongType())]
        part = written(shards.mapInArrow(search, T.StructType(fields)))
        found = part if found is None else found.unionByName(part)
    out = [F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score"]
    if found is None:
        return spark.createDataFrame([], T.StructType([T.StructField("item", item_kind), T.StructField("rank", T.IntegerType()), T.StructField("id", id_kind), T.StructField("score", T.LongType())])).select(*out)
    # Spark limits each task's rows by rank before the exchange, so that an item's rows grow with the tasks, by k each.
    order = Window.partitionBy("pack", "place").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*out)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: The same in DuckDB: every document's score for every item.
OP13_SQL = f"""
WITH words AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_TERMS.format("coalesce(text, '')")} AS terms FROM documents),
docs AS MATERIALIZED (SELECT row, doc_id, terms, len(terms) AS n FROM words WHERE len(terms) > 0),
sizes AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM docs),
postings AS MATERIALIZED (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) GROUP BY row, term),
weights AS MATERIALIZED (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, sizes GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format("coalesce(text, '')")}) AS term FROM benchmark) GROUP BY item_id, term),
shares AS (SELECT p.row, p.term, (1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 75 + (75 * d.n * s.docs) // s.total)) AS share FROM postings p JOIN docs d USING (row), sizes s),
scores AS (SELECT item_id, row, CAST(sum(times * w * share) AS BIGINT) AS score FROM asked JOIN weights USING (term) JOIN shares USING (term) GROUP BY item_id, row),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scores JOIN docs USING (row) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
