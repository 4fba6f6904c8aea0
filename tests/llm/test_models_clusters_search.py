from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import backoff_model, centroid_clustering, ranked_search

from .support import awkward, awkward_rows, empty, prose, rows_of, words

# Language-model scoring


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_scores(rows: list[tuple], order: int, prior: float) -> list[tuple]:
    """The model by its formula, with counts of the whole corpus: no blocks, states or failure arcs."""
    texts = [(i, [*words(lower(t)), None], zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0) for i, t, *_ in rows]
    counts: list[Counter] = [Counter() for _ in range(order)]
    for _, own, held in texts:
        for k in range(0 if held else order):
            counts[k].update(tuple(own[a : a + k + 1]) for a in range(len(own) - k))
    total, distinct = counts[0].total(), len(counts[0])

    def chance(context: tuple, word: str | None) -> float:
        if not context:
            return (counts[0][(word,)] + 0.1) / (total + 0.1 * (distinct + 1))
        return (counts[len(context)][(*context, word)] + prior * chance(context[1:], word)) / (counts[len(context) - 1][context] + prior)

    out = []
    for i, own, held in texts:
        base = sum(math.log10(chance((), w)) for w in own)
        score = sum(math.log10(chance(tuple(own[max(0, a - order + 1) : a]), w)) for a, w in enumerate(own))
        out.append((i, held, len(own), sum(counts[0][(w,)] > 0 for w in own), total, base, score))
    return out


def same_scores(got: list[tuple], want: list[tuple]) -> None:
    def rounded(rows: list[tuple]) -> list[tuple]:
        return sorted(((*r[:5], float(f"{r[5]:.9g}"), float(f"{r[6]:.9g}")) for r in rows), key=repr)

    assert rounded(got) == rounded(want)


@pytest.mark.parametrize(("order", "prior"), [(1, 1.0), (2, 2.0), (3, 0.5), (4, 3.0)])
def test_scores_equal_the_formula(spark, order, prior):
    docs = awkward(spark).withColumn("score", F.lit("clash")).withColumn("block", F.lit(1))
    got = backoff_model.score_texts(docs, order=order, prior=prior, block_bytes=4000, range_keys=700)
    same_scores([tuple(r) for r in got.collect()], brute_scores(awkward_rows(), order, prior))


def test_scores_do_not_depend_on_blocks_ranges_and_lanes(spark):
    docs = awkward(spark, 3)
    one = rows_of(backoff_model.score_texts(docs))
    assert rows_of(backoff_model.score_texts(docs.repartition(1), block_bytes=1, range_keys=50)) == one


def test_an_empty_table_and_one_without_training_rows(spark):
    assert backoff_model.score_texts(empty(spark)).count() == 0
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0]
    docs = spark.createDataFrame([(i, "a b", "", "", 1) for i in held], "doc_id long, text string, lang string, source string, n_chars long")
    assert {tuple(r)[1:] for r in backoff_model.score_texts(docs).collect()} == {(True, 3, 0, 0, 0.0, 0.0)}


def test_the_model_is_a_distribution_and_beats_its_base_on_rows_held_out(spark):
    rnd = random.Random(5)
    rows = [(k, " ".join(f"w{x}" for _ in range(30) for x in rnd.choice([(1, 2, 3), (4, 5), (6, 2, 7)])), "", "", 1) for k in range(300)]
    got = backoff_model.score_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), order=3).collect()
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["score"] for r in held) > 0.8 * sum(r["base_score"] for r in held)  # log10: less is worse
    hashes, tokens, ends = backoff_model.tokens_of(__import__("pyarrow").array([r[1] for r in rows]))
    block = backoff_model.Block(hashes, tokens, ends, 3)
    counts = [np.bincount(at[at >= 0], minlength=len(keys)) for at, keys in zip(block.at, block.keys, strict=True)]
    model = backoff_model.Automaton(block, counts, int(counts[0].sum()), len(hashes))
    unknown = 0.1 / (counts[0].sum() + 0.1 * (len(hashes) + 1))
    last = np.concatenate([[-1], *(keys % len(hashes) for keys in block.keys[:2])])
    for state in np.flatnonzero(last != 0).tolist():  # nothing follows the end of a text
        _, weight = model.step(np.full(len(hashes), state), np.arange(len(hashes)))
        back, at = 0.0, state
        while at:
            back, at = back + model.back[at], int(model.fail[at])
        assert math.isclose((10**weight).sum() + unknown * 10**back, 1, rel_tol=1e-9)


def test_a_frequent_ngram_is_one_entry_a_block(spark):
    docs = spark.createDataFrame([(k, "the the the the", "", "", 1) for k in range(2000)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    stored = backoff_model.blocks(docs, "doc_id", "text", 2)
    assert backoff_model.totals(stored, 2, 4).count() <= 4 * 4
    got = backoff_model.score_texts(docs)
    assert got.select("score").distinct().count() == 1 and got.count() == 2000


# Centroid clustering


def brute_clusters(rows: list[tuple], k: int, rounds: int, dims: int) -> list[tuple]:
    kept = [(i, [math.floor(64 * x) for x in v], v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    drawn = sorted(kept, key=lambda r: (hashlib.sha256(b"1:" + (b"null" if r[0] is None else str(r[0]).encode())).hexdigest(), r[2]))[:k]
    centroids = [r[1] for r in drawn]

    def assign() -> list[tuple[int, int]]:
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v, _ in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centroids)):
            own = [kept[j][1] for j, (_, m) in enumerate(found) if m == n]
            if own:
                centroids[n] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    found, inertia = assign(), Counter()
    for away, n in found:
        inertia[n] += away
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, away, inertia[n], inertia.total(), digest[n]) for (i, _, _), (away, n) in zip(kept, found, strict=True)), key=repr)


def vectors(seed: int, n: int, dims: int) -> list[tuple]:
    rnd = random.Random(seed)
    rows: list[tuple] = [(k, [rnd.choice([-1, 0, 0.3, 1.5]) if k % 3 else rnd.gauss(0, 1) for _ in range(dims)]) for k in range(n)]
    rows += [(1000 + k, [0.5] * dims) for k in range(20)] + [(2000, None), (2001, []), (2002, [1.0] * (dims + 1)), (2003, [None] + [1.0] * (dims - 1)), (2004, [math.nan] * dims), (2005, [1.0] * (dims - 1) + [math.inf]), (2006, [-0.001] * dims)]
    return rows + [(None, [0.25] * dims), (3000, [1.0] * dims), (3000, [1.0] * dims), (3001, [-1000.0] * dims)]


@pytest.mark.parametrize(("k", "rounds", "dims"), [(16, 3, 4), (5, 2, 3), (40, 1, 2), (1, 1, 4), (500, 1, 2)])
def test_clusters_equal_brute_force(spark, k, rounds, dims):
    rows = vectors(k, 150, dims)
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    docs = spark.createDataFrame([(i, v, "clash", 0) for i, v in rows], "vec_id long, embedding array<float>, cluster string, label int").repartition(3)
    got = centroid_clustering.with_inertia(*centroid_clustering.cluster_vectors(docs, k=k, rounds=rounds, dims=dims))
    assert rows_of(got, "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256") == brute_clusters(rows, k, rounds, dims)


def test_no_vectors_and_vectors_too_large(spark):
    schema = "vec_id long, embedding array<double>"
    none = centroid_clustering.with_inertia(*centroid_clustering.cluster_vectors(spark.createDataFrame([], schema)))
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and none.count() == 0
    short = spark.createDataFrame([(1, [1.0])], schema)
    assert centroid_clustering.cluster_vectors(short)[0].count() == 0
    with pytest.raises(ValueError, match="beyond"):
        centroid_clustering.cluster_vectors(spark.createDataFrame([(1, [1e30])], schema), dims=1)


@pytest.mark.parametrize("spread", [2, 50, 10_000])
def test_the_tree_finds_the_nearest_with_ties_and_opens_less_than_all(spread):
    draw = np.random.default_rng(spread)
    centroids = draw.integers(-spread, spread + 1, (200, 2))
    points = draw.integers(-spread, spread + 1, (3000, 2))
    who, best, done = centroid_clustering.VantageTree(centroids).nearest(points)
    away = ((points[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    assert np.array_equal(who, away.argmin(1)) and np.array_equal(best, away.min(1))
    assert done < 0.5 * away.size


def test_identical_centroids_end_in_the_smallest_number():
    tree = centroid_clustering.VantageTree(np.zeros((300, 3), np.int64))
    who, best, _ = tree.nearest(np.array([[0, 0, 0], [5, 0, 0]]))
    assert who.tolist() == [0, 0] and best.tolist() == [0, 25]


# Ranked lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_ranks(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    own = [(i, TERM.findall(lower(t))) for i, t, *_ in docs]
    own = [(i, t, Counter(t)) for i, t in own if t]
    n, total = len(own), sum(len(t) for _, t, _ in own)
    df = Counter(t for _, _, c in own for t in c)
    out = []
    for item, text in items:
        asked, found = Counter(TERM.findall(lower(text))), []
        for i, terms, tf in own:
            m = 25 + 75 * len(terms) * n // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t, times in asked.items() if tf[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def question_rows(seed: int = 2) -> list[tuple]:
    rnd = random.Random(seed)
    rows = [(k, prose(rnd, rnd.randrange(1, 40), 60)) for k in range(30)]
    return rows + [(50, None), (51, ""), (52, " ,.;"), (53, "nowhere-to-be-found"), (54, "w1 " * 500), (None, "w2 w3"), (55, "w4"), (55, "w4"), (56, "Straße ΣΑΣ é STRAßE 12345 again")]


@pytest.mark.parametrize(("shard_bytes", "pack_bytes", "k"), [(1, 1, 10), (3000, 400, 3), (1 << 20, 1 << 20, 10)])
def test_ranks_equal_brute_force(spark, shard_bytes, pack_bytes, k):
    rnd = random.Random(9)
    rows = awkward_rows() + [(500 + j, prose(rnd, rnd.randrange(1, 60), 40), "en", "s", 1) for j in range(150)]
    docs = spark.createDataFrame([(*r[:2], "clash") for r in rows], "doc_id long, text string, score string").repartition(4)
    items = spark.createDataFrame([(*r, 5) for r in question_rows()], "item_id long, text string, rank int").repartition(2)
    got = ranked_search.ranked_search(docs, items, shard_bytes=shard_bytes, pack_bytes=pack_bytes, k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(got) == brute_ranks(rows, question_rows(), k)


def test_search_over_and_for_nothing(spark):
    items = spark.createDataFrame(question_rows(), "item_id long, text string")
    assert ranked_search.ranked_search(empty(spark), items).count() == 0
    assert ranked_search.ranked_search(awkward(spark), items.limit(0)).count() == 0


def test_accumulators_stop_before_the_frequent_terms():
    """Two documents hold the rare term; none of the 1,000 that only hold the frequent one gets an accumulator."""
    docs = np.concatenate([[3, 7], np.arange(1000)])
    shares = np.concatenate([[900, 800], np.full(1000, 10)])
    place, score, made = ranked_search.search_shard({"rare": 0, "usual": 1}, [slice(0, 2), slice(2, 1002)], docs, shares, [("rare", 5), ("usual", 1)], 1000, 2)
    assert place.tolist() == [3, 7] and score.tolist() == [4510, 4010] and made == 2
    # A tie with the k-th is still possible: accumulators go on.
    _, _, made = ranked_search.search_shard({"rare": 0, "usual": 1}, [slice(0, 2), slice(2, 1002)], docs, shares, [("rare", 5), ("usual", 400)], 1000, 2)
    assert made == 1000


def test_ranks_are_limited_in_tasks_before_the_exchange(spark):
    plan = ranked_search.ranked_search(awkward(spark), spark.createDataFrame(question_rows(), "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
