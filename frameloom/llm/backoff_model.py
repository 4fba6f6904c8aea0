"""Language-model scoring: a weighted backoff automaton over smoothed n-grams.

The model is an n-gram model with hierarchical Dirichlet smoothing. Its lowest order is the base model, add-0.1 over the V distinct
training tokens and one unknown: p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)). Each higher order mixes in the order below,
p(w | h) = (c(h w) + mu p(w | h')) / (c(h) + mu), h' being h less its first word. As an automaton: every context h that the training rows hold is a
state; an n-gram h w of theirs is an arc from h with log10 p(w | h), to the longest context that ends there; any other word takes the failure arc to
h' with weight log10 mu / (c(h) + mu). A text is scored in one walk from left to right that carries the state and adds up weights.

The model grows with the corpus, so it is never held whole. Texts are cut into blocks of about ``BLOCK_BYTES`` (whole texts), stored as
token numbers. A block asks for the counts of its own distinct n-grams, in packed rows that are exchanged by ranges of hashes; each range adds
up what all blocks counted in training rows, and answers every block with the totals of what it asked for. With those a block builds the part of
the automaton that its texts can reach, which gives them the very scores of the whole one, and walks it. A frequent n-gram is counted in its block first, so it is one entry a
block; no range holds more than some ``RANGE_KEYS`` entries (and those of one n-gram, one a block).

The walk goes side by side over lanes of ``LANE`` tokens. A lane starts ``order - 1`` tokens early, from the root: a state is the
longest context among the last ``order - 1`` tokens, and contexts' beginnings and ends are contexts, so it then is in the text's own state.

n-grams are told apart by 63-bit hashes: of n different ones n^2 / 2^64 pairs may be confused by chance (4e-4 at 30 GB).

Defined results: a null text counts as empty, and has one token, its end; a null identifier hashes as the empty string, so such rows
are held out; repeated rows are counted and scored once each; without training rows every score is the base model's over an unknown
token alone (0); an empty table gives an empty result; other columns of the input are ignored, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, partitions, small_batches, written

#: Words of the longest n-gram.
ORDER = 2
#: What the order below counts for, in occurrences of the context.
PRIOR = 30.0
#: Added to each token's count in the base model (fixed by the contract).
ADDED = 0.1
#: Bytes of text of a block, one text at least.
BLOCK_BYTES = 2 << 20
#: Entries (an n-gram of a block) of a range of hashes, on average.
RANGE_KEYS = 500_000
LANE = 64
#: The end of a text, as a token that no word can be.
END = b" "


def held_out(identifier: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(identifier.cast("string"), F.lit(""))), F.lit(10)) == 0


# Packed numbers: byte planes, so that equal high bytes stand together where Spark compresses.
def pack(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :width] = planes.T
    return wide.view("<u8").ravel().astype(np.int64)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=0), 8)


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, 8))


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from those of its beginning and its last word: 63 bits."""
    x = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return (x >> np.uint64(1)).astype(np.int64)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens, all tokens in turn as places among these, and where each text ends. A-Z count as a-z; the end is token 0."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    coded = pc.dictionary_encode(split.flatten())
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    if b"" in words:  # texts that begin or end with white space
        full = at != words.index(b"") + 1
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[full], minlength=len(lengths))
        at = at[full]
    ends = np.cumsum(lengths + 1)
    tokens = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    own = np.ones(len(tokens), bool)
    own[ends - 1] = False
    tokens[own] = at
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) >> 1 for w in [END, *words]), np.int64, len(words) + 1)
    return hashes, tokens, ends


@dataclass
class Block:
    """Texts as tokens, and their distinct n-grams: of each order, keys (place of the beginning, last token) in order, and the keys' hashes."""

    hashes: np.ndarray
    tokens: np.ndarray
    ends: np.ndarray
    order: int

    def __post_init__(self) -> None:
        n, v = len(self.tokens), len(self.hashes)
        starts = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else np.zeros(0, np.int64)
        since = np.arange(n) - np.repeat(starts, np.diff(self.ends, prepend=0))  # tokens of the text before this one
        self.keys, self.codes, self.at = [np.arange(v)], [self.hashes], [self.tokens]
        for k in range(1, self.order):
            ok = np.flatnonzero(since >= k)
            key = self.at[-1][ok - 1] * v + self.tokens[ok]
            sorted_ = np.argsort(key)
            new = np.diff(key[sorted_], prepend=-1) != 0
            distinct = key[sorted_][new]
            at = np.full(n, -1, np.int64)  # the place of the n-gram that ends here, if the text is long enough
            at[ok[sorted_]] = np.cumsum(new) - 1
            begin, last = np.divmod(distinct, v)
            self.keys.append(distinct)
            self.codes.append(mixed(self.codes[-1][begin], self.hashes[last]))
            self.at.append(at)

    def asked(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All n-grams' hashes in order, how often each stands in the texts marked in ``train``, and whether it is a single token."""
        mine = np.repeat(train, np.diff(self.ends, prepend=0))
        counts = [np.bincount(at[mine & (at >= 0)], minlength=len(keys)) for at, keys in zip(self.at, self.keys, strict=True)]
        codes, counts = np.concatenate(self.codes), np.concatenate(counts)
        order = np.argsort(codes)
        return codes[order], counts[order], order < len(self.hashes)

    def told(self, counts: np.ndarray) -> list[np.ndarray]:
        """By order, the counts of its keys, from those in the order of hashes."""
        codes = np.concatenate(self.codes)
        own = np.empty(len(codes), np.int64)
        own[np.argsort(codes)] = counts
        return np.split(own, np.cumsum([len(k) for k in self.keys])[:-1])


class Automaton:
    """The part of the backoff automaton that a block's texts can reach. State 0 is the root, the others are contexts by order and key."""

    def __init__(self, block: Block, counts: list[np.ndarray], total: int, distinct: int, prior: float = PRIOR) -> None:
        v, order = len(block.hashes), block.order
        self.v = v
        self.first = first = np.concatenate([[1], 1 + np.cumsum([len(k) for k in block.keys[: order - 1]])])  # states of an order begin here
        lowest = (counts[0] + ADDED) / (total + ADDED * (distinct + 1))
        self.root = np.log10(lowest)
        self.fail = np.zeros(int(first[-1]), np.int64)
        self.back = np.zeros(int(first[-1]))
        state = [np.zeros(v, np.int64)] if order == 1 else [np.where(counts[0] > 0, first[0] + np.arange(v), 0)]
        self.root_next = state[0]
        chance = [lowest]
        arcs, weights, nexts = [], [], []
        for k in range(1, order):
            begin, last = np.divmod(block.keys[k], v)
            have = counts[k - 1][begin]
            # The same n-gram less its first word: its place one order below.
            shorter = last if k == 1 else np.searchsorted(block.keys[k - 1], self._tail(block, k, begin) * v + last)
            p = (counts[k] + prior * chance[k - 1][shorter]) / (have + prior)
            chance.append(p)
            seen = counts[k] > 0
            to = np.where(seen, first[k] + np.arange(len(seen)), 0) if k < order - 1 else state[k - 1][shorter]
            state.append(to)
            arcs.append((first[k - 1] + begin[seen]) * v + last[seen])
            weights.append(np.log10(p[seen]))
            nexts.append(to[seen])
            context = first[k - 1] + np.arange(len(counts[k - 1]))
            self.back[context] = np.log10(prior / (counts[k - 1] + prior))
            if k > 1:
                own = np.divmod(block.keys[k - 1], v)
                tail = own[1] if k == 2 else np.searchsorted(block.keys[k - 2], self._tail(block, k - 1, own[0]) * v + own[1])
                self.fail[context] = state[k - 2][tail]
        self.arcs, self.weights, self.nexts = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((arcs, np.int64), (weights, float), (nexts, np.int64)))

    @staticmethod
    def _tail(block: Block, k: int, begin: np.ndarray) -> np.ndarray:
        """Places of the beginnings (of k words) less their first word, one order below."""
        head, last = np.divmod(block.keys[k - 1][begin], len(block.hashes))
        return last if k == 2 else np.searchsorted(block.keys[k - 2], Automaton._tail(block, k - 1, head) * len(block.hashes) + last)

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and the weights on the way: failure arcs until a state has an arc for the token; the root has one for all."""
        weight, after = np.zeros(len(state)), np.zeros(len(state), np.int64)
        left = np.arange(len(state))
        while len(left):
            at_root = state[left] == 0
            done = left[at_root]
            weight[done] += self.root[token[done]]
            after[done] = self.root_next[token[done]]
            left = left[~at_root]
            if not len(left):
                break
            key = state[left] * self.v + token[left]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            hit = self.arcs[arc] == key if len(self.arcs) else np.zeros(len(key), bool)
            done = left[hit]
            weight[done] += self.weights[arc[hit]]
            after[done] = self.nexts[arc[hit]]
            left = left[~hit]
            weight[left] += self.back[state[left]]
            state = state.copy()
            state[left] = self.fail[state[left]]
        return after, weight

    def walk(self, block: Block, lane: int = LANE) -> np.ndarray:
        """log10 probability of each text."""
        lengths = np.diff(block.ends, prepend=0)
        starts = block.ends - lengths
        lanes = -(-lengths // lane)
        text = np.repeat(np.arange(len(lengths)), lanes)
        number = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = starts[text] + number * lane
        size = np.minimum(block.ends[text], begin + lane) - begin
        early = np.minimum(block.order - 1, begin - starts[text])
        state, score = np.zeros(len(text), np.int64), np.zeros(len(text))
        for t in range(-int(early.max(initial=0)), int(size.max(initial=0))):
            on = np.flatnonzero((t >= -early) & (t < size))
            state[on], weight = self.step(state[on], block.tokens[begin[on] + t])
            if t >= 0:
                score[on] += weight
        return np.bincount(text, score, minlength=len(lengths))


def blocks(docs: DataFrame, id_col: str, text_col: str, order: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, ids, train, ends, hashes, tokens, n_train, n_keys), a row a block."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), (~held_out(F.col(id_col))).alias("train"), F.col(text_col).alias("text"))

    def block(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        hashes, tokens, ends = tokens_of(table.column(2).combine_chunks())
        train = table.column(1).to_numpy()
        ids = table.column(0).combine_chunks()
        # A number a task and block: the table is written, so only numbers of finished tasks are ever seen.
        name = (TaskContext.get().partitionId() << 32) + number  # type: ignore[union-attr]
        values = [[name], [ids.to_pylist()], [train.tolist()], [pack(ends, 8)], [pack(hashes, 8)], [pack(tokens, 4)], [int(np.diff(ends, prepend=0)[train].sum())], [len(hashes) + (order - 1) * len(tokens)]]
        kinds = [pa.int64(), pa.list_(ids.type), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(values, kinds, strict=True)], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        for whole in batches:
            step = max(1, whole.num_rows * block_bytes // max(1, whole.nbytes))
            for at in range(0, whole.num_rows, step):
                held.append(whole.slice(at, step))
                size += held[-1].nbytes
                if size >= block_bytes:
                    yield block(held, number)
                    held, size, number = [], 0, number + 1
        if held:
            yield block(held, number)

    names = ["block", "ids", "train", "ends", "hashes", "tokens", "n_train", "n_keys"]
    types = [T.LongType(), T.ArrayType(kind), T.ArrayType(T.BooleanType()), T.BinaryType(), T.BinaryType(), T.BinaryType(), T.LongType(), T.LongType()]
    return rows.mapInArrow(cut, T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)]))


def ranges_of(codes: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of hashes begins in sorted hashes, and the end."""
    edges = [-(-(r << 63) // ranges) for r in range(ranges)]
    return np.append(np.searchsorted(codes, np.array(edges, np.int64)), len(codes))


def totals(stored: DataFrame, order: int, ranges: int) -> DataFrame:
    """(block, range, counts, distinct): answers to each block by range; one row a range has, in ``distinct``, its tokens of training rows."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, train, ends, hashes, tokens in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                own = Block(unpack(hashes, 8), unpack(tokens, 4), unpack(ends, 8), order)
                codes, counts, single = own.asked(np.array(train, bool))
                at = ranges_of(codes, ranges)
                full = np.flatnonzero(np.diff(at))
                cuts = [slice(at[r], at[r + 1]) for r in full]
                columns = [pa.array(full, pa.int32()), pa.array([name] * len(full), pa.int64()), pa.array([pack_sorted(codes[c]) for c in cuts], pa.binary()), pa.array([pack(counts[c], 4) for c in cuts], pa.binary()), pa.array([np.packbits(single[c]).tobytes() for c in cuts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["range", "block", "codes", "counts", "single"])

    asked = stored.select("block", "train", "ends", "hashes", "tokens").mapInArrow(ask, "range int, block long, codes binary, counts binary, single binary")

    def answer(table: pa.Table) -> pa.Table:
        codes = [unpack_sorted(x) for x in table.column("codes").to_pylist()]
        counts = np.concatenate([unpack(x, 4) for x in table.column("counts").to_pylist()])
        every = np.concatenate(codes)
        order_ = np.argsort(every)
        every = every[order_]
        new = np.append(True, every[1:] != every[:-1])
        group = np.cumsum(new) - 1
        total = np.bincount(group, counts[order_]).astype(np.int64)  # sums below 2**53 are exact
        single = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(c)).astype(bool) for x, c in zip(table.column("single").to_pylist(), codes, strict=True)])
        known = int(np.count_nonzero(total[np.unique(group[single[order_]])])) if single.any() else 0
        back = np.empty(len(every), np.int64)
        back[order_] = total[group]
        own = np.split(back, np.cumsum([len(c) for c in codes])[:-1])
        return pa.table({"block": table.column("block"), "range": table.column("range"), "counts": pa.array([pack(x, 8) for x in own], pa.binary()), "distinct": pa.array([known] + [0] * (len(own) - 1), pa.int64())})

    return asked.groupBy("range").applyInArrow(answer, "block long, range int, counts binary, distinct long")


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, prior: float = PRIOR, block_bytes: int = BLOCK_BYTES, range_keys: int = RANGE_KEYS) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    kind = docs.schema[id_col].dataType
    stored = written(blocks(docs, id_col, text_col, order, block_bytes))
    sizes = stored.agg(F.sum("n_train").alias("n_train"), F.sum("n_keys").alias("n_keys")).first()
    n_train, ranges = sizes["n_train"] or 0, max(1, partitions(docs.sparkSession), -(-(sizes["n_keys"] or 0) // range_keys))
    answers = written(totals(stored, order, ranges))
    distinct = answers.agg(F.sum("distinct").alias("n")).first()["n"] or 0

    def walk(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["ids"] is not None)
        block = Block(unpack(own["hashes"], 8), unpack(own["tokens"], 4), unpack(own["ends"], 8), order)
        found = sorted((r for r in rows if r["ids"] is None), key=lambda r: r["range"])
        counts = block.told(np.concatenate([unpack(r["counts"], 8) for r in found]))
        lengths = np.diff(block.ends, prepend=0)
        text = np.repeat(np.arange(len(lengths)), lengths)
        if n_train:
            model = Automaton(block, counts, n_train, distinct, prior)
            base, score = np.bincount(text, model.root[block.tokens], minlength=len(lengths)), model.walk(block)
        else:
            base = score = np.zeros(len(lengths))
        known = np.bincount(text, counts[0][block.tokens] > 0, minlength=len(lengths)).astype(np.int64)
        columns = [pa.array(own["ids"], table.schema.field("ids").type.value_type), pa.array([not t for t in own["train"]]), pa.array(lengths), pa.array(known), pa.array(np.full(len(lengths), n_train)), pa.array(base), pa.array(score)]
        return pa.table(columns, names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    texts = stored.select("block", "ids", "train", "ends", "hashes", "tokens", F.lit(None).cast("int").alias("range"), F.lit(None).cast("binary").alias("counts"))
    told = answers.select("block", *(F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in ("ids", "train", "ends", "hashes", "tokens")), "range", "counts")
    fields = [T.StructField(id_col, kind), T.StructField("held_out", T.BooleanType()), *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
    return texts.unionByName(told).groupBy("block").applyInArrow(walk, T.StructType(fields))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))
