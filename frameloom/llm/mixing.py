"""Mixing sources to target weights: entropy balancing of document rates under token constraints.

Among all rates r_d in (0, cap] with sum over a source of r_d * size_d = target, the one nearest to 1 in
relative entropy is the exponential tilt r_d = min(cap, exp(lambda_s * size_d / scale_s)). The convex dual has one
multiplier a source; safeguarded Newton steps solve it, each step's gradient and curvature being summed by Spark
over a table of (source, size, rows). Rates become whole copies, floor or ceiling, by error diffusion in words
from a source's longest documents to its shortest.

Sums are decimal, so that the order of additions, and with it the number of tasks, changes nothing: reruns agree.

Defined results: a null text has size 0; size-0 rows are taken once (0 words); a null source is a source of its
own, last in order; identical rows are rounded apart but by rank, so the set of results is the same in each run;
an empty table gives an empty result; columns of the input that bear an output name give way.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut_lineage, documents, free_name, without, words_of

CAP = 3
WEIGHTS = (1, 2, 3)
#: Rows of one (source, size) that are ranked together, on average, when extra copies are dealt.
RANKED = 10_000
#: A step bound that no convex dual comes near: each fourth step halves the bracket. Beyond it, solve_tilts raises.
NEWTON_STEPS = 400


def water_fill(sizes: Sequence[int], weights: Sequence[float], cap: float = CAP) -> list[float]:
    """Targets that share sum(sizes) by weight and stop at cap * size, the excess reshared until none is above."""
    targets, rest = [0.0] * len(sizes), float(sum(sizes))
    open_ = set(range(len(sizes)))
    while open_:
        weight = math.fsum(weights[k] for k in open_)
        above = [k for k in sorted(open_) if rest * weights[k] / weight > cap * sizes[k]]
        if not above:
            for k in open_:
                targets[k] = rest * weights[k] / weight
            break
        for k in above:
            targets[k] = float(cap * sizes[k])
        rest -= math.fsum(targets[k] for k in above)
        open_ -= set(above)
    return targets


def solve_tilts(stats: DataFrame, targets: dict, scales: dict, cap: float = CAP, most_steps: int = NEWTON_STEPS) -> dict:
    """lambda by source. ``stats`` is (source, size, n); None stands for a rate of ``cap`` throughout.

    The driver holds one row a source of the mix (the targets are given by source anyway), Spark the sums. A tilt is settled when
    the tokens miss their target by 1e-9 of it at most, or the bracket is as narrow as doubles allow; if that takes more than
    ``most_steps``, RuntimeError is raised.
    """
    spark = stats.sparkSession
    tilt: dict = {}
    bounds: dict = {}
    for s, (total, target) in targets.items():
        if total and target >= cap * total * (1 - 1e-12):
            tilt[s] = None
        elif not total or target == total:
            tilt[s] = 0.0
        else:
            bounds[s] = (0.0, math.inf, 0.0) if target > total else (-math.inf, 0.0, 0.0)
    for turn in itertools.count(1):
        if not bounds:
            return tilt
        if turn > most_steps:
            raise RuntimeError(f"the tilts of {len(bounds)} sources did not settle in {most_steps} steps")
        now = spark.createDataFrame([(s, b[2], scales[s]) for s, b in bounds.items()], "of string, lam double, scale double")
        x = F.col("size") / F.col("scale")
        rate = F.least(F.lit(float(cap)), F.exp(F.col("lam") * x))
        pull = F.col("n") * F.col("size") * rate
        sums = (
            stats.join(F.broadcast(now), F.col("source").eqNullSafe(F.col("of")))  # as many rows as the mix has sources
            .groupBy("of")
            .agg(F.sum(pull.cast("decimal(38,6)")).cast("double").alias("g"), F.sum(F.when(rate < cap, pull * x).otherwise(0.0).cast("decimal(38,6)")).cast("double").alias("h"))
            .collect()
        )
        for row in sums:
            s, (low, high, at) = row["of"], bounds[row["of"]]
            miss = row["g"] - targets[s][1]
            if abs(miss) <= 1e-9 * targets[s][1] + 1e-6 or high - low <= 1e-13 * max(1.0, abs(at)):
                tilt[s] = at
                del bounds[s]
                continue
            low, high = (low, at) if miss > 0 else (at, high)
            step = at - miss / row["h"] if row["h"] > 0 else math.nan
            if not low < step < high or turn % 4 == 0:
                step = (low + high) / 2 if math.isfinite(low + high) else (2 * at + 1 if math.isinf(high) else 2 * at - 1)
            bounds[s] = (low, high, step)


def deal_extras(strata: pd.DataFrame) -> pd.DataFrame:
    """How many rows of each stratum of a source get one copy above their rate's floor.

    Sizes are walked from the longest down, and each takes over what the longer ones missed, in words, so the whole
    source misses its target by about its shortest documents. One row a distinct size, not a document.
    """
    strata = strata.sort_values("size", ascending=False, kind="stable")
    owed, extras = 0.0, []
    for size, n, rate in zip(strata["size"], strata["n"], strata["rate"], strict=True):
        part = rate - math.floor(rate)
        owed += part * n * size
        extra = min(n, max(0, round(owed / size))) if size and part else 0
        owed -= extra * size
        extras.append(extra)
    return strata.assign(extra=np.asarray(extras, np.int64))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, cap: int = CAP, ranked: int = RANKED, prefix: str = "", size_col: str | None = None) -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies. ``weights`` repeat over the sources in code-point order.

    ``size_col`` names a column of known sizes, where texts have been counted before.
    """
    spark = docs.sparkSession
    names = [prefix + n for n in ("size", "source_size", "target", "rate", "copies")]
    known = docs.withColumn(names[0], words_of(F.col(text_col))) if size_col is None else docs.withColumn(names[0], F.col(size_col))
    docs = without(docs, names)
    size, place = (free_name(docs, f"mix_{x}") for x in ("size", "place"))
    sized = known.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(f"`{names[0]}`").alias(size))
    # The texts are counted once for all sums, and once more where whole rows are dealt.
    light = cut_lineage(sized.select(F.col(source_col).alias("source"), F.col(size).alias("size"), F.col(id_col).alias("id")))
    stats = cut_lineage(light.groupBy("source", "size").agg(F.count("*").alias("n")))
    totals = stats.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total"), F.sum(F.col("n")).alias("rows"), F.sum((F.col("size") * F.col("size") * F.col("n")).cast("decimal(38,0)")).cast("double").alias("square"))
    found = sorted(totals.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))  # one row a source of the mix
    targets = water_fill([r["total"] for r in found], [weights[k % len(weights)] for k in range(len(found))], cap)
    by_source = {r["source"]: (r["total"], t) for r, t in zip(found, targets, strict=True)}
    scales = {r["source"]: (r["square"] / r["total"] if r["total"] else 1.0) for r in found}
    tilts = solve_tilts(stats, by_source, scales, cap)
    told = spark.createDataFrame([(s, int(a), float(t), tilts.get(s), scales[s]) for s, (a, t) in by_source.items()], "of string, total long, goal double, lam double, scale double")

    # Strata of equal rates: whole copies for all rows, one more for `extra` of them.
    rate = F.when(F.col("lam").isNull(), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.round(F.col("lam"), 12) * F.col("size") / F.col("scale"))))
    strata = stats.join(F.broadcast(told), F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate)
    kind = strata.select("source", "size", "n", "rate", "total", "goal")
    strata = cut_lineage(kind.groupBy("source").applyInPandas(deal_extras, kind.withColumn("extra", F.lit(0).cast("long")).schema))

    # Large strata are ranked in salted parts; each part gets its share of the extra copies exactly.
    salts = max(1, -(-sum(r["rows"] for r in found) // ranked))
    keys = ["k1", "k2", "k3"]

    def key(source, size):
        return [F.coalesce(source, F.lit("")).alias("k1"), source.isNull().alias("k2"), size.alias("k3")]

    parts = light.select(*key(F.col("source"), F.col("size")), F.pmod(F.xxhash64("id"), F.lit(salts)).alias("k4")).groupBy(*keys, "k4").agg(F.count("*").alias("m"))
    within = Window.partitionBy(*keys).orderBy("k4").rowsBetween(Window.unboundedPreceding, 0)
    plan = parts.join(strata.select(*key(F.col("source"), F.col("size")), "n", "extra", "rate", "total", "goal"), keys).withColumn("seen", F.sum("m").over(within))
    share = "CAST(extra AS DECIMAL(18,0)) * CAST({} AS DECIMAL(18,0)) DIV n"
    plan = plan.withColumn("extra", F.expr(share.format("seen")) - F.expr(share.format("(seen - m)")))

    new = {k: free_name(docs, f"mix_{k}") for k in (*keys, "k4")}
    keyed = sized.select("*", *(c.alias(new[k]) for k, c in zip(keys, key(F.col(source_col), F.col(size)), strict=True)), F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).alias(new["k4"]))
    ranks = Window.partitionBy(*new.values()).orderBy(F.xxhash64(F.col(id_col), F.lit(11)), F.col(id_col))
    ranked_rows = keyed.withColumn(place, F.row_number().over(ranks))
    outs = {n: free_name(docs, f"mix_{n}") for n in ("extra", "rate", "total", "goal")}
    plan = plan.select(*(F.col(k).alias(new[k]) for k in new), *(F.col(n).alias(outs[n]) for n in outs))
    joined = ranked_rows.join(plan, list(new.values()))
    copies = F.when(F.col(size) == 0, F.lit(1)).otherwise(F.floor(F.col(outs["rate"])) + (F.col(place) <= F.col(outs["extra"])).cast("long"))
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(size).alias(names[0]), F.col(outs["total"]).alias(names[1]), F.col(outs["goal"]).alias(names[2]), F.col(outs["rate"]).alias(names[3]), copies.cast("long").alias(names[4]))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = cut_lineage(documents(spark, sf_dir).select("doc_id", "source", words_of(F.col("text")).alias("size")))
    mixed = mix(sized, size_col="size")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: a document without words stays once, an empty table stays empty."""
    prefix = free_name(docs, "mix_") + "_"
    mixed = mix(docs, prefix=prefix)
    return mixed.withColumn(prefix + "copies", F.explode(F.expr(f"array_repeat(1, CAST(`{prefix}copies` AS INT))"))).select(*docs.columns)
