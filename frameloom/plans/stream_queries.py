"""Registered queries that run streams to their end; each has the result of its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixtures as fx
from ..operators import pages as page_ops
from ..streaming import live, progress, runs
from . import detector_queries, edit_queries, packet_queries


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in three micro-batches by time; the end row of a source comes in the last one."""
    frames = fx.frames(spark, sf_dir).withColumn("is_end", F.lit(False))
    ends = frames.groupBy("source_id").agg((F.max("ordinal") + 1).cast("int").alias("ordinal"), (F.max("pts") + 1000).alias("pts"))
    ends = ends.select("source_id", "ordinal", "pts", F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(None).cast("array<smallint>").alias("px"), F.lit(True).alias("is_end"))
    return frames.select(*ends.columns).unionByName(ends)


_TURNS = ["ordinal < 13 AND NOT is_end", "ordinal BETWEEN 13 AND 30 AND NOT is_end", "ordinal > 30 OR is_end"]


def t01_live_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = runs.run_in_turns(_frames(spark, sf_dir), _TURNS, lambda stream: live.live_segments(stream, fx.SMALL))
    return got.where("row = 'segment'").select("source_id", "segment_ix", "first_ordinal", "last_ordinal", "start_ticks", "end_ticks")


def t02_live_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = runs.run_in_turns(_frames(spark, sf_dir), _TURNS, lambda stream: live.live_anchor_groups(stream, fx.SMALL_ANCHOR))
    return got.where("row = 'group'").drop("row", "pts")


def t03_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first half of each source's frames every fifth comes again after that half, and is put out as a reject."""
    frames = _frames(spark, sf_dir).where("NOT is_end")
    early = 2 * F.col("ordinal") < F.count("*").over(Window.partitionBy("source_id"))
    frames = frames.withColumn("early", early)
    late = frames.where("early AND ordinal % 5 = 0").withColumn("turn", F.lit(1))
    rows = frames.withColumn("turn", F.when(F.col("early"), 0).otherwise(2)).unionByName(late)
    got = runs.run_in_turns(rows, ["turn = 0", "turn = 1", "turn = 2"], lambda stream: live.live_segments(stream, fx.SMALL))
    return got.where("row = 'reject'").select("source_id", "pts")


STALL, TOTAL = 6 * 3_600_000_000, 30 * 3_600_000_000


def t04_stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watches over users, whose counters often repeat or fall: given up after 6 hours without an advance, or 30 hours in all.

    The events come in three turns by time; a last row, far beyond them, moves the watermark past all limits.
    """
    counter = F.floor(F.col("event_id") / 40) + F.pmod(F.col("event_id") * 7, F.lit(25))
    rows = fx.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source_id"), F.col("ts").cast("timestamp").alias("ts"), counter.cast("long").alias("counter"), (F.col("event_type") == "error").alias("is_end"))
    span = rows.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    if span["low"] is None:
        return spark.createDataFrame([], progress.WATCHES)
    third = (span["high"] - span["low"]) / 3
    cuts = [span["low"] + third, span["low"] + 2 * third]
    turned = rows.withColumn("turn", F.when(F.col("ts") < F.lit(cuts[0]), 0).when(F.col("ts") < F.lit(cuts[1]), 1).otherwise(2))
    beyond = rows.sparkSession.range(1).select(F.lit("").alias("source_id"), (F.lit(span["high"]) + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(0).cast("long").alias("counter"), F.lit(False).alias("is_end"), F.lit(3).alias("turn"))
    got = runs.run_in_turns(turned.unionByName(beyond), [f"turn = {k}" for k in range(4)], lambda stream: progress.watches(stream, stall_us=STALL, total_us=TOTAL, delay="0 SECONDS"))
    return got.where("source_id <> ''")


def t05_latest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' largest counters in update mode; they arrive out of order, a fifth of the events first."""
    rows = packet_queries.events(spark, sf_dir).select("source_id", F.col("pts").alias("counter"), (F.col("event_id") % 5).alias("turn"))
    got = runs.run_in_turns(rows, ["turn = 4", "turn < 2", "turn BETWEEN 2 AND 3"], progress.latest, "update", "unsaferow")
    return runs.latest_rows(got, ["source_id"])


def t06_live_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = edit_queries.Fixture(spark, sf_dir)
    resolved = page_ops.resolve(edit_queries.adds(f).union(edit_queries.deletes(f)).union(edit_queries.moves(f)), f.samples, f.segments)
    resolved = resolved.withColumn("new_id", page_ops.manual_id(F.col("source_id"), F.col("to_ordinal"), F.col("seq")))
    columns = ["source_id", "seq", "kind", "page_ids", "to_ordinal", "to_ticks", "to_segment_ix", "new_id"]
    first = f.pages.select("source_id", F.lit(0).cast("long").alias("seq"), F.lit("load").alias("kind"), F.lit(None).cast("array<string>").alias("page_ids"), F.col("rep_ordinal").alias("to_ordinal"), F.col("ticks").alias("to_ticks"), F.col("derived_segment_ix").alias("to_segment_ix"), F.col("page_id").alias("new_id"))
    got = runs.run_in_turns(first.unionByName(resolved.select(*columns)), ["seq = 0", "seq BETWEEN 1 AND 2", "seq > 2"], live.live_edits)
    return got.select("source_id", "seq", "status", "code")


def t07_live_gap_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = packet_queries.key_times(spark, sf_dir).select("source_id", F.col("ticks").alias("pts"), F.lit(False).alias("is_end"))
    ends = keys.select("source_id").distinct().select("source_id", F.lit(packet_queries.DURATION).alias("pts"), F.lit(True).alias("is_end"))
    half = packet_queries.DURATION // 2
    got = runs.run_in_turns(keys.unionByName(ends), [f"pts < {half}", f"pts >= {half}"], lambda stream: live.live_gap_policy(stream, packet_queries.LIMIT))
    return got.where("row = 'policy'").select("source_id", "n", "max_gap", "policy")


QUERIES = {f.__name__: f for f in (t01_live_segments, t02_live_anchor, t03_out_of_order, t04_stalls, t05_latest_progress, t06_live_edits, t07_live_gap_policy)}

SQL = {
    "t01_live_segments": fx.sql("SELECT source_id, segment_ix, first_ordinal, last_ordinal, start_ticks, end_ticks FROM b", fx.FRAMES_SQL, fx.SEGMENTS_SQL),
    "t02_live_anchor": detector_queries.SQL["w08_anchor_detector"],
    "t03_out_of_order": fx.sql("SELECT source_id, pts FROM (SELECT *, 2 * ordinal < count(*) OVER (PARTITION BY source_id) AS early FROM k) WHERE early AND ordinal % 5 = 0", fx.FRAMES_SQL),
    "t04_stalls": f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT CAST(user_id AS VARCHAR) AS source_id, epoch_us(ts) AS t, event_id // 40 + (event_id * 7) % 25 AS counter, event_type = 'error' AS is_end FROM events),
k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY t, is_end, counter) AS k FROM e),
a AS MATERIALIZED (SELECT *, k = 1 OR counter > max(counter) OVER (PARTITION BY source_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS advance FROM k),
n AS MATERIALIZED (SELECT *, min(t) FILTER (advance) OVER (PARTITION BY source_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_advance FROM a),
w AS MATERIALIZED (SELECT *, min(CASE WHEN advance AND (next_advance IS NULL OR next_advance - t >= {STALL}) THEN t + {STALL} END) OVER r AS stalled, min(k) FILTER (is_end) OVER r AS end_k, min(t) FILTER (is_end) OVER r AS end_t
  FROM n WINDOW r AS (PARTITION BY source_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
z AS MATERIALIZED (SELECT source_id, k, t AS started, coalesce(end_t < least(stalled, t + {TOTAL}), false) AS finished, CASE WHEN end_t < least(stalled, t + {TOTAL}) THEN end_t ELSE least(stalled, t + {TOTAL}) END AS ended,
  CASE WHEN end_t < least(stalled, t + {TOTAL}) THEN end_k END AS end_k, CASE WHEN end_t < least(stalled, t + {TOTAL}) THEN 'finished' WHEN t + {TOTAL} <= stalled THEN 'deadline' ELSE 'stall' END AS status FROM w WHERE advance),
j AS MATERIALIZED (SELECT z.*, (SELECT min(a.k) FROM a WHERE a.source_id = z.source_id AND a.advance AND CASE WHEN z.finished THEN a.k > z.end_k ELSE a.t >= z.ended END) AS next_k FROM z),
runs AS (SELECT source_id, k, 1 AS run FROM j WHERE k = 1 UNION ALL SELECT j.source_id, j.next_k, run + 1 FROM runs JOIN j USING (source_id, k) WHERE j.next_k IS NOT NULL)
SELECT source_id, CAST(run AS INT) AS run, started, (SELECT max(a.t) FROM a WHERE a.source_id = j.source_id AND a.advance AND a.k >= j.k AND CASE WHEN j.finished THEN a.k <= j.end_k ELSE a.t < j.ended END) AS progressed, ended,
  (SELECT max(a.counter) FROM a WHERE a.source_id = j.source_id AND a.advance AND a.k >= j.k AND CASE WHEN j.finished THEN a.k <= j.end_k ELSE a.t < j.ended END) AS counter, status FROM runs JOIN j USING (source_id, k)
""",
    "t05_latest_progress": fx.sql("SELECT source_id, max(pts) AS counter FROM ev GROUP BY source_id", packet_queries._E),
    "t06_live_edits": fx.sql(f"{edit_queries._ADDED} UNION ALL SELECT * FROM dj UNION ALL SELECT * FROM rj", *edit_queries._ALL, edit_queries._DELETED.format(cols=edit_queries._COLS), edit_queries._MOVED.format(t="pd")),
    "t07_live_gap_policy": fx.sql("SELECT source_id, n, max_gap, policy FROM po", packet_queries._E),
}
