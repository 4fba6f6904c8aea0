from __future__ import annotations

import hashlib
import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frameloom.llm import bpe

from .support import awkward, awkward_rows, empty, rows_of

PATH = bpe.default_tokenizer()


@pytest.fixture(scope="module")
def tok():
    return bpe.Encoder(PATH)


def halves(n: int, leaf: int) -> list[int]:
    """Where leaves begin if a text of n characters is halved until each fits."""
    if n <= leaf:
        return [0]
    half = n // 2
    return halves(half, leaf) + [half + x for x in halves(n - half, leaf)]


def library(tok, text):
    return tok.lib.encode(text or "", add_special_tokens=False).ids


def tree(tok, text, leaf, window=bpe.WINDOW):
    at = halves(len(text), leaf)
    leaves = []
    for s, e in zip(at, [*at[1:], len(text)], strict=True):
        ids, first, last = tok.spans(text[s:e])
        leaves.append((ids, first + s, last + s))
    return bpe.join_all(tok, text, leaves, at)[0].tolist()


def test_query_equals_the_library(spark, tok):
    docs = awkward(spark).withColumn("ids", F.lit("clash"))
    want = []
    for i, text, *_ in awkward_rows():
        ids = library(tok, text)
        back = tok.lib.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    for leaf in (bpe.LEAF, 700):
        assert rows_of(bpe.digests(bpe.encode_texts(docs, PATH, leaf=leaf))) == sorted(want, key=repr)
    assert bpe.digests(bpe.encode_texts(empty(spark), PATH)).count() == 0


#: Marks of several combining classes, which NFC puts in order over a whole run; signs that compose with what stands before them.
MARKS = "\u0301\u0323\u0327\u0315"
ALPHABETS = [MARKS, MARKS + "a", MARKS * 3 + "e\u00e9o b", "\u1100\u1161\u11a8 \u0301", "\u0f73\u0f71\u0f72\u0f40", "\u0958\u0915\u093c\u0301", "\u3042\u3099\u304c\u0323\u4e00", "ab", "ab'sreve ", "!'s ", "e\u0301\u00e9 ab", "가나각 x", "12 ab'll'd", "a\u0301\u0300'", "''''s", "<|endoftext|> "]


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_tree_concatenation_equals_the_library(tok, alphabet):
    rnd = random.Random(alphabet)
    for _ in range(15):
        text = "".join(rnd.choice(alphabet) if rnd.random() < 0.95 else rnd.choice(["<|endoftext|>", "'ll", " ", "\n", "Σς", "İ"]) for _ in range(rnd.randint(50, 2500)))
        assert tree(tok, text, rnd.choice([20, 100, 400])) == library(tok, text)


def test_runs_of_marks_longer_than_the_window(tok):
    rnd = random.Random(4)
    for run in (60, 300, 2000):
        for _ in range(6):
            marks = "".join(rnd.choice(MARKS) for _ in range(run))
            text = "plain words " * rnd.randint(0, 60) + rnd.choice(["e", "", " "]) + marks + " and more of them" * rnd.randint(0, 60)
            assert tree(tok, text, 400, window=64) == library(tok, text)


def test_long_texts_with_runs_of_marks_through_spark(spark, tok):
    """Beyond LEAF with all defaults: a run of 900 marks across the middle of plain words, and marks alone."""
    rnd = random.Random(8)
    run = lambda n: "".join(rnd.choice(MARKS) for _ in range(n))
    plain = "The quick brown fox jumps over the lazy dog. " * 400
    texts = [plain[:16_800] + run(900) + plain[:16_801] for _ in range(2)] + [run(40_000), "e" + run(33_000) + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in bpe.encode_texts(docs, PATH).collect()}
    for i, text in enumerate(texts):
        ids = library(tok, text)
        assert got[i] == (ids, tok.lib.decode(ids, skip_special_tokens=False))


def test_parted_agrees_with_normalization():
    """Where a text is parted, normalizing its sides apart changes nothing."""
    rnd = random.Random(6)
    signs = MARKS + "ae\u00e9 \u1100\u1161\u11a8\uac00\u0f71\u0f72\u0f73\u0f40\u0958\u0915\u093c\u3042\u3099\u304c\u4e00\uf900\u0344\u0308"
    both = set()
    for _ in range(3000):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randint(2, 8)))
        at = rnd.randrange(1, len(text))
        both.add(ok := bpe.parted(text, at))
        if ok:
            assert unicodedata.normalize("NFC", text[:at]) + unicodedata.normalize("NFC", text[at:]) == unicodedata.normalize("NFC", text)
    assert both == {True, False}


def test_many_copies_of_a_long_row_do_not_meet_in_one_task(spark, tok):
    text = "again " * 300
    docs = spark.range(9000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text")).union(spark.createDataFrame([(1, text)] * 3, "doc_id long, text string"))
    coded = bpe.encode_texts(docs, PATH, leaf=700)
    got = coded.groupBy("doc_id", F.sha2("ids", 256).alias("ids")).count().collect()
    want = hashlib.sha256(np.array(library(tok, text), "<u4").tobytes()).hexdigest()
    assert sorted((tuple(r) for r in got), key=repr) == [(1, want, 3), (None, want, 9000)]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300), st.integers(5, 60))
def test_any_text_round_trips(text, leaf):
    tok = bpe.encoder(PATH)
    assert tree(tok, text, leaf) == library(tok, text)
    packed, back = tok.encode(text.encode("utf-8", "surrogatepass")) if text.isprintable() else (np.array(library(tok, text), "<u4").tobytes(), tok.lib.decode(library(tok, text), skip_special_tokens=False))
    assert np.frombuffer(packed, "<u4").tolist() == library(tok, text)
    assert back == tok.lib.decode(library(tok, text), skip_special_tokens=False)


def test_windows_stay_small_on_ordinary_text(tok):
    text = "The quick brown fox jumps over the lazy dog. " * 2000
    spans = tok.spans
    seen = []
    tok.spans = lambda t: seen.append(len(t)) or spans(t)
    try:
        half = len(text) // 2
        left, right = spans(text[:half]), spans(text[half:])
        bpe.join(tok, text, left, (right[0], right[1] + half, right[2] + half), 0, half, len(text))
    finally:
        tok.spans = spans
    assert max(seen) < 3000


def test_plain_words_equal_the_library(tok):
    """All signs of the plain alphabet, beside each other, in words of one to four."""
    rnd = random.Random(12)
    signs = [chr(c) for c in [*range(33, 127), *range(192, 256)]] + list("''''ßÿÀ×÷µªº²½­\u0085 ")
    for _ in range(4000):
        word = "".join(rnd.choice(signs) for _ in range(rnd.randint(1, 4)))
        ids, text = tok.encode(word.encode())
        assert np.frombuffer(ids, "<u4").tolist() == library(tok, word), word
        assert text == tok.lib.decode(library(tok, word), skip_special_tokens=False), word


def test_another_tokenizer_goes_through_the_whole_library(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    other = bpe.Encoder(path)
    assert not other.by_word and bpe.Encoder(PATH).by_word
    want = sorted(((i, library(other, text), other.lib.decode(library(other, text), skip_special_tokens=False)) for i, text, *_ in awkward_rows()), key=repr)
    for leaf in (bpe.LEAF, 700):
        got = bpe.encode_texts(awkward(spark), path, leaf=leaf).collect()
        assert sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in got), key=repr) == want


def test_what_a_worker_keeps_is_bounded():
    tok = bpe.Encoder(PATH)
    tok.encode(b"short " + b"x" * 10_000)
    assert max(map(len, tok.words)) <= bpe.KEPT_BYTES and max(map(len, tok.pieces)) <= bpe.KEPT_BYTES


@pytest.mark.parametrize("alphabet", ["aaaaaaaab", "ab", "'", "-=-=_"])
def test_long_unsplit_runs_join_exactly(tok, alphabet):
    """No blank for many windows: the joins lie inside one pre-token, where only pairs of tokens decide."""
    rnd = random.Random(alphabet)
    for n in (3000, 9001):
        text = "".join(rnd.choice(alphabet) for _ in range(n))
        assert tree(tok, text, 500, window=64) == library(tok, text)
