from __future__ import annotations

import corpus_pipeline
import pytest

import __spark_entry__
from frameloom.llm import queries as registered


def test_all_operators_and_the_pipeline_are_registered():
    names = set(__spark_entry__.queries())
    assert set(registered.queries()) <= names
    assert {n.split("_")[0] for n in registered.queries()} == {f"op{k}" for k in range(1, 11)} | {"pipeline"}
    assert set(registered.oracle_sql()) <= names


def test_stages_have_the_order_and_columns_asked_for(spark, smoke_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "simhash near-dedup", "mixing", "bpe"]
    out = corpus_pipeline.run(spark, smoke_dir)
    assert {"doc_id", "n_tokens", "ids_sha256"} <= set(out.columns)
    assert out.count() > 50


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_each_stage_takes_awkward_and_empty_tables(spark, smoke_dir, stage):
    from .support import awkward, empty

    name, run = corpus_pipeline.STAGES[stage]
    docs = awkward(spark)
    out = run(spark, docs, smoke_dir)
    if name != "bpe":
        assert out.columns == docs.columns
    assert 0 < out.count() <= 3 * docs.count()
    assert run(spark, empty(spark), smoke_dir).count() == 0


def test_the_pipeline_equals_brute_force(spark, tmp_path):
    """All five stages over a small table: rules, copies and near copies by plain Python, the mix by its targets, ids by the library."""
    import hashlib
    import random
    from collections import Counter

    import numpy as np

    from frameloom.llm import bpe, mixing
    from frameloom.llm import quality_rules as qr

    from .support import SCHEMA, awkward_rows, prose, words
    from .test_dedup import brute_components, brute_exact, brute_print
    from .test_quality import brute_base

    rnd = random.Random(31)
    rows = [r for r in awkward_rows() if r[0] != 150]
    base = prose(rnd, 200).split()
    rows += [(500 + k, " ".join([*base[: 9 * k], f"other{k}", *base[9 * k + 1 :]]), "en", f"s{k % 3}", 1) for k in range(15)]
    rows += [(600 + k, prose(rnd, 80), "en", f"s{k % 4}", 1) for k in range(80)]
    trusted = set(range(0, 40)) | set(range(600, 650))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in trusted], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    features = [qr.ngram_buckets(*qr.word_ids((r[1] or "").encode().split()), qr.BUCKETS) for r in rows]
    raw, target = np.zeros(qr.BUCKETS), np.zeros(qr.BUCKETS)
    for r, found in zip(rows, features, strict=True):
        np.add.at(raw, found, 1)
        if r[0] in trusted:
            np.add.at(target, found, 1)
    p_raw = (raw + qr.SMOOTHING) / (raw + qr.SMOOTHING).sum()
    ratio = np.log((target + qr.SMOOTHING * qr.BUCKETS * p_raw) / (target.sum() + qr.SMOOTHING * qr.BUCKETS) / p_raw)
    good = [r for r, found in zip(rows, features, strict=True) if len(found) and not brute_base(r[1])[-1] and ratio[found].mean() >= qr.THRESHOLD]
    kept = {i for i, _, _, stays, _ in brute_exact(good) if stays}
    single = [r for r in good if r[0] in kept]
    assert len(good) < len(rows) and len(single) < len(good) and all(r[0] is not None for r in single)
    labels = brute_components([brute_print(r[1]) for r in single], 4)
    least: dict = {}
    for r, c in zip(single, labels, strict=True):
        least[c] = min(least.get(c, r[0]), r[0])
    apart = {r[0]: r for r in single if r[0] in least.values()}
    assert len(apart) < len(single)

    lib = bpe.Encoder(bpe.default_tokenizer()).lib
    for r in got:
        ids = lib.encode(apart[r["doc_id"]][1], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    copies = Counter(r["doc_id"] for r in got)
    assert max(copies.values()) <= mixing.CAP
    sources = sorted({r[3] for r in apart.values()}, key=lambda s: (s is None, s or ""))
    sizes = {i: len(words(r[1])) for i, r in apart.items()}
    own = [[i for i, r in apart.items() if r[3] == s] for s in sources]
    goals = mixing.water_fill([sum(sizes[i] for i in ids) for ids in own], [mixing.WEIGHTS[k % 3] for k in range(len(own))])
    for ids, goal in zip(own, goals, strict=True):
        assert abs(sum(copies[i] * sizes[i] for i in ids) - goal) <= max(sizes[i] for i in ids)


def test_an_empty_table_stays_empty(spark, tmp_path):
    from .support import empty

    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
