"""Jobs of a batch, their outputs and outcomes, timings, and the usage of frame stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import nfc_casefold


def stem(path: Column) -> Column:
    """The last part of a path less its last suffix."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    short = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return short


def plan_outputs(jobs: DataFrame, folder: str, with_json: bool = True) -> DataFrame:
    """(job_ix, input, kind, target): ``<folder>/<stem>.slides.pdf`` and, if asked for, ``.json``."""
    kinds = [F.struct(F.lit(k).alias("kind"), F.lit(e).alias("suffix")) for k, e in (("pdf", ".slides.pdf"), ("json", ".slides.json"))[: 1 + with_json]]
    return jobs.select("job_ix", "input", stem(F.col("input")).alias("stem"), F.explode(F.array(*kinds)).alias("k")).select("job_ix", "input", F.col("k.kind").alias("kind"), F.concat(F.lit(folder.rstrip("/") + "/"), "stem", "k.suffix").alias("target"))


def output_collisions(outputs: DataFrame) -> DataFrame:
    """(job_ix, kind, target, reason): targets that are equal but for composition and case, or that are some input."""
    keyed = outputs.withColumn("key", nfc_casefold("target"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    inputs = outputs.select(nfc_casefold("input").alias("key")).distinct()
    twice = keyed.join(shared, "key", "left_semi").select("job_ix", "kind", "target", F.lit("SharedTarget").alias("reason"))
    taken = keyed.join(inputs, "key", "left_semi").select("job_ix", "kind", "target", F.lit("TargetIsInput").alias("reason"))
    return twice.union(taken)


def source_results(pages: DataFrame) -> DataFrame:
    """(source_id, page_count, representative_pts): the times of a source's pages, in order."""
    return pages.groupBy("source_id").agg(F.count("*").alias("page_count"), F.array_sort(F.collect_list("pts")).alias("representative_pts"))


def settled(jobs: DataFrame) -> DataFrame:
    """Jobs (batch, job_ix, status) as a batch runner leaves them: after the first cancelled one, the rest is skipped."""
    before = Window.partitionBy("batch").orderBy("job_ix").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.max((F.col("status") == "cancelled").cast("int")).over(before), F.lit(0)) == 1
    return jobs.withColumn("outcome", F.when(gone, "skipped").otherwise(F.col("status")))


def batch_summary(jobs: DataFrame) -> DataFrame:
    """(batch, succeeded, failed, skipped, status, exit_code, outcomes): cancelled outranks error, error success."""
    by = settled(jobs).groupBy("batch").agg(
        F.count_if(F.col("outcome") == "success").alias("succeeded"), F.count_if(F.col("outcome") == "error").alias("failed"), F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.bool_or(F.col("outcome") == "cancelled").alias("c"), F.array_sort(F.collect_list(F.struct("job_ix", "outcome"))).alias("rows"),
    )
    status = F.when(F.col("c"), "cancelled").when(F.col("failed") > 0, "error").otherwise("success")
    code = F.when(F.col("c"), 130).when(F.col("failed") > 0, 1).otherwise(0)
    return by.select("batch", "succeeded", "failed", "skipped", status.alias("status"), code.alias("exit_code"), F.array_join(F.transform("rows", lambda r: r["outcome"]), ",").alias("outcomes"))


PHASES = ("total", "sampling", "packet_index", "decode_wait", "jpeg_encode", "cache_write", "roi", "cache_prepare", "detection", "gray_staging", "representative_selection", "assembly")


def phase_times(timings: DataFrame, phases: tuple[str, ...] = PHASES) -> DataFrame:
    """(run, a column a phase, detector_exclusive): seconds by phase; detection less the preparation inside it."""
    by = timings.groupBy("run").pivot("phase", list(phases)).agg(F.sum("seconds"))
    by = by.select("run", *(F.coalesce(p, F.lit(0).cast(by.schema[p].dataType)).alias(p) for p in phases))
    return by.withColumn("detector_exclusive", F.greatest(F.col("detection") - F.col("cache_prepare"), F.lit(0).cast("long")))


def store_usage(files: DataFrame, reservations: DataFrame) -> DataFrame:
    """(session, total_bytes, image_bytes, outstanding): what a session holds, and what is still reserved for it beyond its images.

    Sessions that have reserved room but no file yet are listed too.
    """
    by = files.groupBy("session").agg(F.sum("bytes").alias("total_bytes"), F.sum(F.when(F.col("is_image"), F.col("bytes")).otherwise(0)).alias("image_bytes"))
    held = reservations.groupBy("session").agg(F.sum("ceiling").alias("ceiling"))
    none = F.lit(0).cast("long")
    joined = by.join(held, "session", "full").select("session", *(F.coalesce(c, none).alias(c) for c in ("total_bytes", "image_bytes", "ceiling")))
    return joined.select("session", "total_bytes", "image_bytes", F.greatest(none, F.col("ceiling") - F.col("image_bytes")).alias("outstanding"))


def expired_sessions(sessions: DataFrame, pins: DataFrame, now: Column, complete_after: int, incomplete_after: int) -> DataFrame:
    """Unpinned sessions whose age in seconds reaches the limit of their kind, with age and rank (1: oldest)."""
    aged = sessions.withColumn("age", (now - F.col("updated_at")).cast("long")).where(F.col("age") >= F.when(F.col("complete"), complete_after).otherwise(incomplete_after))
    return aged.join(pins.select("session").distinct(), "session", "left_anti")
