from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import quality_classifier as qc
from frameloom.llm import quality_rules as qr

from .support import awkward, empty, rows_of, words


def brute_base(text: str | None) -> tuple:
    text = text or ""
    own = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = Counter(tuple(own[k : k + 8]) for k in range(len(own) - 7))
    covered = {k + j for k in range(len(own) - 7) if windows[tuple(own[k : k + 8])] > 1 for j in range(8)}
    failed = len(own) < 20 or 100 * len(covered) > 30 * len(own)
    return len(own), sum(map(len, own)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_base_measures_equal_brute_force(spark):
    docs = awkward(spark).withColumn("kept", F.lit("clash")).withColumn("Trusted", F.lit(1))
    good = spark.createDataFrame([(k,) for k in range(20)] + [(None,)], "doc_id long")
    got = qr.quality_rules(docs, good)
    assert got.schema["kept"].dataType.simpleString() == "boolean" and "Trusted" in got.columns
    for row in got.collect():
        want = brute_base(row["text"])
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"], row["base_failed"]) == want
        assert row["kept"] == (not want[-1] and row["llr"] >= qr.THRESHOLD)
    assert got.count() == docs.count()


def test_ratios_equal_brute_force(spark):
    docs = awkward(spark)
    good = spark.createDataFrame([(k,) for k in range(20)], "doc_id long")
    raw, target = np.zeros(qr.BUCKETS), np.zeros(qr.BUCKETS)
    features = {}
    for row in docs.collect():
        found = qr.ngram_buckets(*qr.word_ids((row["text"] or "").encode().split()), qr.BUCKETS)
        features[row["doc_id"], row["text"]] = found
        np.add.at(raw, found, 1)
        if row["doc_id"] is not None and row["doc_id"] < 20:
            np.add.at(target, found, 1)
    p_raw = (raw + qr.SMOOTHING) / (raw + qr.SMOOTHING).sum()
    p_target = (target + qr.SMOOTHING * qr.BUCKETS * p_raw) / (target.sum() + qr.SMOOTHING * qr.BUCKETS)
    for row in qr.quality_rules(docs, good).collect():
        found = features[row["doc_id"], row["text"]]
        want = float(np.log(p_target / p_raw)[found].mean()) if len(found) else 0.0
        assert row["llr"] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("words", [1, 4, 1 << 17])
def test_the_filter_of_identifiers_misses_none(spark, words):
    docs = spark.range(500).select(F.col("id").alias("doc_id"))
    ids = docs.where("doc_id % 5 = 0")
    marked = {r["doc_id"]: r["m"] for r in qr.perhaps(docs, "doc_id", ids, "m", words).collect()}
    assert len(marked) == 500 and all(marked[k] for k in range(0, 500, 5))
    if words > 4:
        assert sum(marked.values()) <= 102


def test_no_trusted_rows_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long")
    got = qr.quality_rules(awkward(spark), none)
    assert got.where("llr <> 0 OR kept = base_failed").count() == 0
    assert qr.quality_rules(empty(spark), none).count() == 0


def test_stage_keeps_columns_and_clean_rows(spark, tmp_path):
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = awkward(spark).withColumn("rule_kept", F.lit(True))
    out = qr.stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    clean = [r["doc_id"] for r in docs.where("doc_id < 40").collect() if not brute_base(r["text"])[-1]]
    assert set(clean) <= {r["doc_id"] for r in out.collect()}


def test_classifier_learns_and_takes_awkward_rows(spark):
    good = [(k, f"the house on the hill number{k} is warm and the river runs by", 1) for k in range(200)]
    bad = [(1000 + k, f"BUY!! NOW$$$ cheap*** offer{k} click### here%%% free&&&", 0) for k in range(200)]
    docs = spark.createDataFrame([r[:2] for r in good + bad] + [(5000, None), (5001, ""), (None, "words"), (1, "the house")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(None, 1), (7, None), (3, 1)], "doc_id long, quality int")
    got = qc.classify(docs.withColumn("score", F.lit("clash")), labels)
    rows = got.collect()
    truth = {i: q for i, _, q in good + bad}
    tested = [r for r in rows if r["doc_id"] in truth and r["held_out"]]
    assert len(tested) > 60
    assert np.mean([(r["score"] > 0.5) == bool(truth[r["doc_id"]]) for r in tested]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert not next(r for r in rows if r["doc_id"] is None)["held_out"]


def test_classifier_without_or_with_one_sided_labels(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in qc.classify(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(k, 1) for k in range(30)], "doc_id long, quality int")
    assert all(r["score"] > 0.9 for r in qc.classify(docs, one).collect())
    assert qc.classify(empty(spark), one).count() == 0


def test_held_out_is_crc32_of_the_text_of_the_identifier(spark):
    import zlib

    got = spark.range(200).select("id", qc.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


def test_training_sample_is_bounded(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert len(qc.training_rows(docs, labels, id_col="doc_id", text_col="text", label_col="quality", bound=50)) == 50


def test_scores_do_not_depend_on_partitions(spark):
    docs = awkward(spark)
    good = spark.createDataFrame([(k,) for k in range(20)], "doc_id long")
    assert rows_of(qr.quality_rules(docs, good).drop("text")) == rows_of(qr.quality_rules(docs.repartition(7), good).drop("text"))


def plain_features(text: str | None) -> Counter:
    """Features and their numbers as the docstring states them, a word and a gram at a time."""
    import xxhash

    found: Counter = Counter()
    for w in words(text):
        found[xxhash.xxh3_64_intdigest(w.encode(), 1) % qc.BUCKETS] += 1
        marked = f"<{w}>"
        for n in qc.GRAMS:
            for k in range(len(marked) - n + 1):
                found[xxhash.xxh3_64_intdigest(marked[k : k + n].encode()) % qc.BUCKETS] += 1
    return found


def plain_training(rows: list[tuple[int, Counter]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stated network by loops over vectors: averaged features, softmax, one step a row, the rate falling to zero."""
    draw = np.random.default_rng(qc.SEED)
    vectors = draw.uniform(-1 / qc.DIMENSIONS, 1 / qc.DIMENSIONS, (qc.BUCKETS, qc.DIMENSIONS))
    softmax, bias, done = np.zeros((2, qc.DIMENSIONS)), np.zeros(2), 0
    for _ in range(qc.EPOCHS):
        for k in draw.permutation(len(rows)):
            label, found = rows[k]
            rate, done = qc.RATE * (1 - done / (qc.EPOCHS * len(rows))), done + 1
            total = max(1, sum(found.values()))
            hidden = sum((n / total * vectors[f] for f, n in found.items()), np.zeros(qc.DIMENSIONS))
            odds = np.exp(softmax @ hidden + bias)
            miss = odds / odds.sum() - np.eye(2)[label]
            back = miss @ softmax
            softmax -= rate * np.array([m * hidden for m in miss])
            bias -= rate * miss * 0.1
            for f, n in found.items():
                vectors[f] -= rate * qc.DIMENSIONS * n / total * back
    return vectors, softmax, bias


def test_classifier_equals_a_plain_one(spark):
    """Features, training and scores anew: a sample of awkward texts, scored by the whole network."""
    docs = awkward(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("quality"))
    rows = qc.training_rows(docs, labels, id_col="doc_id", text_col="text", label_col="quality")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = [i for i in texts if not (zlib.crc32(str(i).encode()) % 4 == 2)]
    own = sorted((int(i % 3 == 0), sorted(plain_features(texts[i]).items())) for i in known)
    assert sorted((label, list(zip(b.tolist(), c.astype(int).tolist(), strict=True))) for label, b, c in rows) == own
    vectors, softmax, bias = plain_training([(label, Counter(dict(zip(b.tolist(), c.tolist(), strict=True)))) for label, b, c in rows])
    for r in qc.classify(docs, labels).collect():
        found = plain_features(r["text"])
        hidden = sum((n / max(1, sum(found.values())) * vectors[f] for f, n in found.items()), np.zeros(qc.DIMENSIONS))
        odds = np.exp(softmax @ hidden + bias)
        assert r["score"] == pytest.approx(odds[1] / odds.sum(), abs=1e-6)


def test_held_out_documents_are_told_apart(spark):
    """Accuracy on the rows of the given documents whose labels were never seen."""
    at = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in qc.op9_quality_classifier(spark, at).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{at}/labels.parquet").where("quality IS NOT NULL").collect()]
    tested = [(got[i]["predicted"], q) for i, q in labels if i in got and got[i]["held_out"]]
    assert len(tested) > 50 and np.mean([p == q for p, q in tested]) > 0.93


def test_training_features_are_bounded_by_bytes(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text "), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    args = {"id_col": "doc_id", "text_col": "text", "label_col": "quality"}
    every = qc.training_rows(docs, labels, **args)
    some = qc.training_rows(docs, labels, most_bytes=sum(8 * len(r[1]) for r in every[:10]), **args)
    assert len(some) == 10 and all(np.array_equal(a[1], b[1]) for a, b in zip(some, every, strict=False))
