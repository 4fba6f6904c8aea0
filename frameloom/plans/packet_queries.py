"""Registered queries over packets (``events``): timing, policies, and lookups by time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixtures as fx
from ..functions import rational
from ..operators import lookups, policies, scans
from ..sources import packet_source
from ..sources import packets as source
from .staging import shared_folder

START = 1_704_067_200_000_000  # 2024-01-01 in microseconds
DURATION = 31 * 86_400_000_000
LIMIT = 561_600_000_000  # 6.5 days
#: Rows of a stretch of the one long source, about.
LONG_STRETCH = 5000
#: Ticks of a stretch, a day: longer sources are ordered by a task a stretch.
STRETCH = 86_400_000_000
#: Bytes of a stretch of a packet index.
INDEX_STRETCH = 4 << 20


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, pts, event_type, value): one source a user, a microsecond clock."""
    return fx.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source_id"), (F.unix_micros(F.col("ts").cast("timestamp")) - START).alias("pts"), "event_type", "value", "event_id")


def key_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'view'").select("source_id", F.col("pts").alias("ticks")).distinct()


def sources(rows: DataFrame) -> DataFrame:
    return rows.select("source_id").distinct().withColumn("duration_ticks", F.lit(DURATION))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("source_id").orderBy("ticks")
    return key_times(spark, sf_dir).withColumn("ordinal", (F.row_number().over(order) - 1).cast("int"))


def s02_key_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet lines; every eleventh source has a line without a number, which rejects it."""
    broken = (F.col("source_id").cast("int") % 11 == 0) & (F.col("event_id") % 7 == 0)
    line = F.concat(F.lit("pts="), F.when(broken, F.lit("N/A")).otherwise(F.col("pts").cast("string")), F.lit("|flags="), F.when(F.col("event_type") == "view", "K__").otherwise("___"))
    lines = events(spark, sf_dir).select("source_id", F.col("pts").alias("line_no"), line.alias("value"))
    good, _ = source.key_packets(lines, lines.select("source_id", F.lit(0).cast("long").alias("origin_pts")).distinct())
    return good.select("source_id", "pts", "is_key")


def s02_packet_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the packets of twelve sources, written as one text file each and read again by byte ranges: the byte that a line begins at gives its order."""
    rows = fx.table(spark, sf_dir, "events").select(F.pmod(F.col("user_id"), F.lit(12)).cast("string").alias("source_id"), F.col("event_id").cast("long").alias("pts"), "event_type")
    line = F.concat(F.lit("pts="), F.col("pts").cast("string"), F.lit("|flags="), F.when(F.col("event_type") == "view", "K__").otherwise("___")).alias("value")
    path = f"{shared_folder(spark)}/packets-{uuid.uuid4().hex}"
    rows.repartitionById(12, F.col("source_id").cast("int")).sortWithinPartitions("source_id", "pts").select("source_id", line).write.partitionBy("source_id").text(path)
    lines = packet_source.read_packet_lines(spark, path, 16 << 10).withColumn("source_id", F.regexp_extract("source_id", "source_id=([^/]+)/", 1))
    good, _ = source.key_packets(lines, rows.select("source_id", F.lit(0).cast("long").alias("origin_pts")).distinct(), INDEX_STRETCH)
    return good.select("source_id", "pts", "is_key")


def w01_time_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = key_times(spark, sf_dir)
    return policies.time_gaps(keys, sources(keys), DURATION // 16)


def w03_long_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one long source, ordered by many tasks: running count of errors, place, the event before, and the last buyer so far."""
    rows = fx.table(spark, sf_dir, "events").select(F.lit("all").alias("source_id"), F.col("event_id").cast("long").alias("ordinal"), "user_id", "event_type")
    told = scans.running_count(rows, F.col("event_type") == "error", "ordinal", "segment_ix", LONG_STRETCH)
    told = scans.ranks(told, "ordinal", "place", LONG_STRETCH)
    told = scans.neighbours(told, F.col("user_id"), "ordinal", "user_before", "user_after", LONG_STRETCH)
    told = scans.last_known(told, F.when(F.col("event_type") == "purchase", F.col("user_id")), "ordinal", "last_buyer", LONG_STRETCH)
    return told.select("ordinal", "segment_ix", "place", "user_before", "user_after", "last_buyer")


def a01_gap_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = key_times(spark, sf_dir)
    return policies.gap_policy(keys, sources(keys), LIMIT)


def p01_media_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    origin = F.min("pts").over(Window.partitionBy("source_id"))
    tick = rational.ticks(F.col("pts"), F.col("origin"))
    return rows.withColumn("origin", origin).select("event_id", tick.alias("ticks"), rational.seconds(tick, F.lit(1).cast("long"), F.lit(1_000_000).cast("long")).alias("seconds"))


def p11_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).join(a01_gap_policy(spark, sf_dir).select("source_id", "policy"), "source_id")
    return policies.select_observations(rows, F.col("policy")).select("source_id", "ordinal", "ticks", "is_observation")


def p18_resolve_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = key_times(spark, sf_dir)
    user = F.col("source_id").cast("int")
    asked = keys.select("source_id").distinct().select("source_id", F.when(user % 2 == 0, "h264").otherwise("vp9").alias("codec"), F.when(user % 5 == 0, "half").when(user % 7 == 0, "all").otherwise("auto").alias("requested"), (user % 3 != 0).alias("native"))
    return policies.resolve_policy(asked, policies.gap_policy(keys, sources(keys), LIMIT))


def j02_covering_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key opens a segment of its source; the segment of every purchase, if any (the last one ends after 30 days)."""
    order = Window.partitionBy("source_id").orderBy("ticks")
    spans = samples(spark, sf_dir).select("source_id", F.col("ordinal").alias("segment_ix"), F.col("ticks").alias("start_ticks"), F.coalesce(F.lead("ticks").over(order), F.least(F.col("ticks") + 86_400_000_000, F.lit(DURATION))).alias("end_ticks"))
    asks = events(spark, sf_dir).where("event_type = 'purchase'").select("source_id", F.col("pts").alias("ticks"), "event_id")
    return lookups.covering_segment(asks, spans, STRETCH)


def j03_nearest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key nearest to every purchase, moved by a third of a tick and, for every fifth, to the middle of two keys."""
    order = Window.partitionBy("source_id").orderBy("ticks")
    middles = samples(spark, sf_dir).withColumn("next", F.lead("ticks").over(order)).where("ordinal % 5 = 0 AND next IS NOT NULL").select("source_id", (F.col("ticks") + F.col("next")).alias("at_num"), F.lit(2).cast("long").alias("at_den"), (-F.col("ordinal") - 1).cast("long").alias("event_id"))
    asks = events(spark, sf_dir).where("event_type = 'purchase'").select("source_id", (F.col("pts") * 3 + 1).alias("at_num"), F.lit(3).cast("long").alias("at_den"), "event_id")
    return lookups.nearest_sample(asks.unionByName(middles), samples(spark, sf_dir), STRETCH)


def j04_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded: the even keys, less every 9th, and a time of its own every 8th user."""
    rows = samples(spark, sf_dir)
    decoded = rows.where("ordinal % 2 = 0 AND ordinal % 9 <> 4").select("source_id", F.col("ticks").alias("pts")).union(sources(rows).where("CAST(source_id AS INT) % 8 = 0").select("source_id", F.lit(DURATION).alias("pts")))
    return lookups.reconcile(rows.select("source_id", F.col("ticks").alias("pts")), decoded)


def j05_exact_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of clicks asked of the keys and clicks; one in five is asked a tick late, and fails."""
    rows = events(spark, sf_dir)
    frames = rows.where("event_type IN ('view', 'click')").select("source_id", "pts", "value")
    asks = rows.where("event_type = 'click'").select("source_id", (F.col("pts") + (F.col("event_id") % 5 == 0).cast("long")).alias("pts"), "event_id")
    found, failed = lookups.exact_frames(asks, frames)
    return found.select("source_id", "event_id", "pts", "value", F.lit(None).cast("string").alias("reject_code")).unionByName(failed.select("source_id", "event_id", "pts", F.lit(None).cast("double").alias("value"), F.lit("FrameNotFound").alias("reject_code")))


QUERIES = {f.__name__: f for f in (s02_key_packets, s02_packet_index, w01_time_gaps, w03_long_source, a01_gap_policy, p01_media_time, p11_observations, p18_resolve_policy, j02_covering_segment, j03_nearest_sample, j04_reconcile, j05_exact_frames)}

_E = f"""
ev AS MATERIALIZED (SELECT CAST(user_id AS VARCHAR) AS source_id, epoch_us(ts) - {START} AS pts, event_type, value, event_id FROM events),
ky AS MATERIALIZED (SELECT source_id, ticks, CAST(row_number() OVER (PARTITION BY source_id ORDER BY ticks) - 1 AS INT) AS ordinal FROM (SELECT DISTINCT source_id, pts AS ticks FROM ev WHERE event_type = 'view')),
gp AS MATERIALIZED (SELECT source_id, ticks, ticks - coalesce(lag(ticks) OVER w1, 0) AS gap, CASE WHEN lead(ticks) OVER w1 IS NULL THEN {DURATION} - ticks END AS tail FROM ky WINDOW w1 AS (PARTITION BY source_id ORDER BY ticks)),
po AS MATERIALIZED (SELECT source_id, count(*) AS n, greatest(max(gap), max(tail)) AS max_gap, CASE WHEN greatest(max(gap), max(tail)) < {LIMIT} THEN 'half' ELSE 'all' END AS policy, CAST(NULL AS VARCHAR) AS reject_code FROM gp GROUP BY source_id)
"""
SQL = {
    "s02_key_packets": fx.sql("SELECT source_id, pts, true AS is_key FROM ev WHERE event_type = 'view' AND source_id NOT IN (SELECT source_id FROM ev WHERE event_type = 'view' AND CAST(source_id AS INT) % 11 = 0 AND event_id % 7 = 0)", _E),
    "w01_time_gaps": fx.sql("SELECT * FROM gp", _E),
    "a01_gap_policy": fx.sql("SELECT * FROM po", _E),
    "p01_media_time": fx.sql("SELECT event_id, ticks, ticks / 1000000 AS seconds FROM (SELECT event_id, pts - min(pts) OVER (PARTITION BY source_id) AS ticks FROM ev)", _E),
    "p11_observations": fx.sql("SELECT source_id, ordinal, ticks, policy = 'all' OR ordinal % 2 = 0 AS is_observation FROM ky JOIN po USING (source_id)", _E),
    "p18_resolve_policy": fx.sql(
        """SELECT source_id, policy, CASE WHEN policy = 'half' THEN 'native' ELSE 'software' END AS backend FROM (SELECT source_id, CASE WHEN u % 3 <> 0 AND (u % 5 = 0 OR (u % 7 <> 0 AND u % 2 = 0 AND policy = 'half')) THEN 'half' ELSE 'all' END AS policy
        FROM (SELECT *, CAST(source_id AS INT) AS u FROM po))""",
        _E,
    ),
    "j02_covering_segment": fx.sql(
        f"""SELECT e.source_id, e.pts AS ticks, event_id, s.ordinal AS segment_ix FROM ev e LEFT JOIN (SELECT *, coalesce(lead(ticks) OVER (PARTITION BY source_id ORDER BY ticks), least(ticks + 86400000000, {DURATION})) AS stop FROM ky) s
        ON s.source_id = e.source_id AND e.pts >= s.ticks AND e.pts < s.stop WHERE event_type = 'purchase'""",
        _E,
    ),
    "j03_nearest_sample": fx.sql(
        """, rq AS (SELECT source_id, pts * 3 + 1 AS at_num, 3 AS at_den, event_id FROM ev WHERE event_type = 'purchase' UNION ALL
        SELECT source_id, ticks + nxt, 2, -ordinal - 1 FROM (SELECT *, lead(ticks) OVER (PARTITION BY source_id ORDER BY ticks) AS nxt FROM ky) WHERE ordinal % 5 = 0 AND nxt IS NOT NULL)
        SELECT source_id, at_num, CAST(at_den AS BIGINT) AS at_den, event_id, ordinal, ticks FROM (SELECT rq.*, ordinal, ticks, row_number() OVER (PARTITION BY rq.source_id, event_id ORDER BY abs(at_num - ticks * at_den), ticks) AS place
        FROM rq JOIN ky USING (source_id)) WHERE place = 1""",
        _E,
    ).replace("\n,", ",", 1),
    "j04_reconcile": fx.sql(
        f"""SELECT source_id, ordinal, coalesce(ticks, {DURATION}) AS pts, decoded, CASE WHEN ordinal IS NULL OR (ordinal % 2 = 0) <> decoded THEN 'DecodeFailed' END AS reject_code FROM (
        SELECT source_id, ordinal, ticks, ordinal % 2 = 0 AND ordinal % 9 <> 4 AS decoded FROM ky UNION ALL SELECT DISTINCT source_id, NULL, NULL, true FROM ky WHERE CAST(source_id AS INT) % 8 = 0)""",
        _E,
    ),
    "j05_exact_frames": fx.sql(
        """SELECT a.source_id, a.event_id, a.at AS pts, f.value, CASE WHEN f.source_id IS NULL THEN 'FrameNotFound' END AS reject_code FROM (SELECT *, pts + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS at FROM ev WHERE event_type = 'click') a
        LEFT JOIN (SELECT * FROM ev WHERE event_type IN ('view', 'click')) f ON f.source_id = a.source_id AND f.pts = a.at""",
        _E,
    ),
}
SQL["w03_long_source"] = """
WITH e AS (SELECT CAST(event_id AS BIGINT) AS ordinal, user_id, event_type, CASE WHEN event_type = 'purchase' THEN user_id END AS buyer FROM events)
SELECT ordinal, CAST(count(*) FILTER (event_type = 'error') OVER w AS BIGINT) AS segment_ix, row_number() OVER w AS place, lag(user_id) OVER w AS user_before, lead(user_id) OVER w AS user_after,
last_value(buyer IGNORE NULLS) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_buyer FROM e WINDOW w AS (ORDER BY ordinal)
"""
SQL["s02_packet_index"] = "SELECT CAST(user_id % 12 AS VARCHAR) AS source_id, CAST(event_id AS BIGINT) AS pts, true AS is_key FROM events WHERE event_type = 'view'"
