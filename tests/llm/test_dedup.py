from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from frameloom.llm import common, components, exact_dedup, simhash, substring_dedup

from .support import awkward, awkward_rows, empty, prose, rows_of, words


def brute_exact(rows: list[tuple]) -> list[tuple]:
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = []
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known, default=None)
        digest = hashlib.sha256(norm.encode()).hexdigest()
        first = True
        for i in ids:
            kept = i == keep and first
            first = first and not kept
            out.append((i, keep, len(ids), kept, digest))
    return sorted(out, key=repr)


def test_exact_dedup_equals_brute_force(spark):
    docs = awkward(spark).withColumn("keep_id", F.lit("clash")).withColumn("dedup_norm", F.lit(1))
    for least, text in ((1000, True), (2, True), (2, False)):  # with 2, all groups of copies are cut into slots
        got = exact_dedup.exact_dedup(docs, least=least, salts=4, text=text)
        assert ("text" in got.columns) == text
        assert rows_of(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute_exact(awkward_rows())
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_exact_dedup_runs_no_python_and_one_text_exchange(spark):
    told, _ = exact_dedup.runs(awkward(spark), id_col="doc_id", text_col="text", least=25, salts=4)
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning(run_head" not in plan


def test_frequent_beginnings_and_texts_are_cut_and_stitched(spark):
    """One text in a third of all rows, and one beginning that a third shares: no range holds either whole."""
    head = "the same beginning of very many documents "
    rows = [(k, "a frequent text, again and again, longer than a head") for k in range(400)] + [(1000 + k, head + str(k // 2)) for k in range(400)] + [(2000 + k, f"text {k}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    told, own = exact_dedup.runs(docs, id_col="doc_id", text_col="text", least=5, salts=8)
    spread = told.withColumn("part", F.spark_partition_id()).cache()
    for part in ("doc_id < 1000", "doc_id BETWEEN 1000 AND 1999"):
        assert spread.where(part).select("part").distinct().count() > 1, part
    assert spread.where(F.col(own["cut"])).select("doc_id").where("doc_id >= 1000").count() == 0
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs, least=5, salts=8).collect()}
    assert all(got[k] == (0, 400, k == 0) for k in range(400))
    assert all(got[1000 + k] == (1000 + k // 2 * 2, 2, k % 2 == 0) for k in range(400))
    assert all(got[2000 + k] == (2000 + k, 1, True) for k in range(400))


def test_exact_stage_keeps_one_row_a_text(spark):
    docs = awkward(spark)
    out = exact_dedup.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert rows_of(out, "doc_id") == sorted(((r[0],) for r in brute_exact(awkward_rows()) if r[3]), key=repr)


def brute_print(text: str | None) -> int:
    own = [w.encode() for w in words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    if not own:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(own[k : k + 4]), 42) for k in range(max(1, len(own) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints: list[int], radius: int) -> list[int]:
    x = np.array(prints, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    label = np.arange(len(x))
    while True:
        new = np.where(near, label[None, :], len(x)).min(axis=1)
        if (new == label).all():
            return label.tolist()
        label = new


def test_simhash_equals_brute_force(spark):
    rows = awkward_rows()
    got = simhash.simhash_groups(awkward(spark).withColumn("fingerprint", F.lit(1))).drop("text_key")
    prints = [brute_print(r[1]) for r in rows]
    labels = brute_components(prints, 4)
    least = {}
    for (i, *_), c in zip(rows, labels, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted(((r[0], f"{p:016x}", least.get(c)) for r, p, c in zip(rows, prints, labels, strict=True)), key=repr)
    assert rows_of(got) == want
    assert simhash.simhash_groups(empty(spark)).count() == 0


def test_links_span_all_components_for_any_tiling(spark):
    rnd = random.Random(4)
    centres = [rnd.getrandbits(64) for _ in range(30)]
    prints = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, 5))) for c in centres for _ in range(40)} | {0, (1 << 64) - 1, 1}
    prints = sorted(prints)
    want = Counter(Counter(brute_components(prints, 4)).values())
    frame = spark.createDataFrame([(False, k, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(prints)], "none boolean, id long, fp long")
    for tile, subwords in ((2048, 3), (2048, 2), (50, 1), (100, 4)):
        found = components.components(simhash.links(frame, 4, tile, subwords))
        sizes = [r["count"] for r in found.groupBy("root").count().collect()]
        assert Counter(sizes) == Counter({k: v for k, v in want.items() if k > 1})


def test_forest_of_a_tile_is_bounded():
    same = np.arange(16, dtype=np.uint64)  # all within 4 bits
    child, root = simhash.linked(same, None, 4)
    assert len(child) == 15 and set(root.tolist()) == {0}
    child, root = simhash.linked(same[:8], same[8:], 4)
    assert len(child) == 15


def test_components_of_paths_and_hubs(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(7, 7), (3, 2), (2, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(61)} | {1000 + k: 1000 for k in range(50)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hubs_and_copies_are_not_exchanged_whole(spark):
    """A component of a third of all fingerprints, and a fingerprint of a third of all rows."""
    rnd = random.Random(12)
    chain = prose(rnd, 300).split()
    near = [(k, " ".join([*chain[:k], f"changed{k}", *chain[k + 1 :]])) for k in range(150)]
    copies = [(1000 + k, "the very same words in all of these rows") for k in range(200)]
    rows = near + copies + [(2000 + k, prose(rnd, 40)) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    prints = [brute_print(t) for _, t in rows]
    labels = brute_components(prints, 4)
    least = {c: min(i for (i, _), x in zip(rows, labels, strict=True) if x == c) for c in set(labels)}
    want = sorted(((i, f"{p:016x}", least[c]) for (i, _), p, c in zip(rows, prints, labels, strict=True)), key=repr)
    assert max(Counter(labels[:150]).values()) > 100
    assert rows_of(simhash.simhash_groups(docs).drop("text_key")) == want


@pytest.mark.parametrize("most", [1, 3, 10_000])
def test_hot_join_is_a_plain_join(spark, most):
    left = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(100)] + [(None, 1)], "key long, x long")
    right = left.where("key IS NOT NULL").groupBy("key").count().withColumn("y", F.col("key") * 2)
    got = common.join_hot(left, right, "key", "count", 100, most)
    assert got.columns == ["key", "x", "y"]
    assert rows_of(got) == sorted([(k % 7 if k % 3 else 0, k, 2 * (k % 7 if k % 3 else 0)) for k in range(100)], key=repr)


def test_near_dedup_stage_keeps_one_of_each_group(spark):
    rows = awkward_rows()
    docs = awkward(spark).withColumn("text_key", F.lit("clash"))
    out = simhash.stage(spark, docs, "")
    assert out.columns == docs.columns
    labels = brute_components([brute_print(r[1]) for r in rows], 4)
    assert out.count() == len(set(labels))


def test_near_dedup_keeps_components_apart_that_share_a_smallest_identifier(spark):
    rnd = random.Random(11)
    a, b, c, d = (prose(rnd, 60) for _ in range(4))
    rows = [(None, a), (None, a), (None, b), (7, c), (7, d), (8, d)]
    assert len(set(brute_components([brute_print(t) for _, t in rows], 4))) == 4
    out = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert rows_of(out) == sorted([(None, a), (None, b), (7, c), (7, d)], key=repr)


def brute_repeats(rows: list[tuple], window: int) -> list[tuple]:
    texts = [words(r[1]) for r in rows]
    seen = Counter(tuple(t[k : k + window]) for t in texts for k in range(len(t) - window + 1))
    out = []
    for (i, *_), t in zip(rows, texts, strict=True):
        gone = {k + j for k in range(len(t) - window + 1) if seen[tuple(t[k : k + window])] > 1 for j in range(window)}
        out.append((i, len(t), len(gone), " ".join(w for k, w in enumerate(t) if k not in gone)))
    return sorted(out, key=repr)


def test_substring_dedup_equals_brute_force(spark):
    rnd = random.Random(9)
    passage = prose(rnd, 60)
    rows = awkward_rows() + [(300 + k, prose(rnd, 30) + " " + passage + " " + prose(rnd, 40), "en", "s0", 1) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for window, block in ((35, 4 << 20), (8, 2000), (1, 3000)):
        got = substring_dedup.remove_repeats(docs.withColumn("n_words", F.lit(0)), window=window, block_bytes=block, bucket_bytes=5000)
        assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_text") == brute_repeats(rows, window)
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def test_removed_intervals_are_maximal(spark):
    docs = spark.createDataFrame([(1, "a b c d e f x y a b c d e f"), (2, "q")], "doc_id long, text string")
    got = {r["doc_id"]: r["removed"] for r in substring_dedup.remove_repeats(docs, window=4).collect()}
    assert got == {1: [[0, 6], [8, 14]], 2: []}


def test_rolling_equals_the_polynomial():
    rnd = random.Random(2)
    field = substring_dedup._FIELD
    values = [rnd.randrange(field) for _ in range(200)]
    for window in (1, 2, 3, 35, 64):
        for m in substring_dedup._MULTIPLIERS:
            got = substring_dedup.rolled(np.array(values, np.uint64), window, m).tolist()
            assert got == [sum(v * pow(m, window - 1 - j, field) for j, v in enumerate(values[k : k + window])) % field for k in range(200 - window + 1)]


def test_keys_of_different_windows_differ():
    """Each field has word values of its own, so words that meet in one differ in the other."""
    rnd = random.Random(3)
    texts = [[b"w%d" % rnd.randrange(50) for _ in range(400)] for _ in range(20)]
    first, check, doc = substring_dedup.window_keys(texts, 5, substring_dedup._WordValues())
    got = list(zip(first.tolist(), check.tolist(), strict=True))
    want = [tuple(t[k : k + 5]) for t in texts for k in range(396)]
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True)))
    values = substring_dedup._WordValues()
    one, two = values.of([[b"a", b"b", b"a"]], 3)
    assert one[0] == one[2] and two[0] == two[2] and len({*one.tolist(), *two.tolist()}) == 4


def test_a_window_costs_a_few_products_only(monkeypatch):
    """Two products a word and field, and the powers once, whatever the window; stretches meet without a gap."""
    done, times = [], substring_dedup._times
    monkeypatch.setattr(substring_dedup, "_times", lambda a, b: (done.append(len(a)), times(a, b))[1])
    rnd = random.Random(4)
    n = 100_000
    values = np.array([rnd.randrange(substring_dedup._FIELD) for _ in range(n)], np.uint64)
    for window in (35, 63):
        done.clear()
        got = substring_dedup.rolled(values, window, substring_dedup._MULTIPLIERS[0])
        assert len(got) == n - window + 1 and sum(done) < 3 * n
        for k in (0, 16_383, 16_384, 65_535, 65_536, n - window):
            want = 0
            for v in values[k : k + window].tolist():
                want = (want * substring_dedup._MULTIPLIERS[0] + v) % substring_dedup._FIELD
            assert int(got[k]) == want


def test_windows_that_only_the_check_tells_apart():
    first, check = np.array([7, 3, 7, 7, 3, 7], np.uint64), np.array([2, 1, 1, 2, 1, 1], np.uint32)
    order, number = substring_dedup.distinct_keys(first, check)
    assert list(zip(first[order].tolist(), check[order].tolist(), number.tolist(), strict=True)) == [(3, 1, 0), (3, 1, 0), (7, 1, 1), (7, 1, 1), (7, 2, 2), (7, 2, 2)]


def test_packing_round_trip():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 5, 1000):
        first = np.sort(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        check, again = rnd.integers(0, 1 << 32, n).astype(np.uint32), rnd.random(n) < 0.3
        if n:
            out = substring_dedup.unpack(substring_dedup.pack(first, check, again))
            assert all(np.array_equal(a, b) for a, b in zip(out, (first, check, again), strict=True))
