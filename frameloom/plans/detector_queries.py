"""Registered queries: regions of interest, local changes, the anchor detector, and order checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixtures as fx
from ..operators import anchor, changes, checks, roi


def bordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with black borders: every second source has an outer ring, source 3 is black, source 5 is lit in three rows."""
    label, y, x = F.col("source_id").cast("int"), lambda i: F.floor(i / 8), lambda i: i % 8
    lit = lambda i: F.when(label == 3, False).when(label == 5, y(i).between(2, 4)).when(label % 2 == 0, y(i).between(1, 6) & x(i).between(1, 6)).otherwise(True)
    return fx.frames(spark, sf_dir).withColumn("px", F.transform("px", lambda v, i: F.when(lit(i), v).otherwise(F.lit(0).cast("short"))))


BORDERED_SQL = """
p8 AS MATERIALIZED (SELECT source_id, ordinal, y, x, CASE WHEN source_id = '3' THEN 0 WHEN source_id = '5' AND y NOT BETWEEN 2 AND 4 THEN 0
  WHEN CAST(source_id AS INT) % 2 = 0 AND NOT (y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6) THEN 0 ELSE v END AS v FROM p WHERE ordinal < 8),
md AS MATERIALIZED (SELECT source_id, y, x, median(v) AS v FROM p8 GROUP BY ALL),
pr AS MATERIALIZED (SELECT source_id, 'y' AS side, y AS i, median(v) AS v FROM md GROUP BY ALL UNION ALL SELECT source_id, 'x', x, median(v) FROM md GROUP BY ALL),
ex AS MATERIALIZED (SELECT source_id, coalesce(min(i) FILTER (side = 'x' AND v > 8), 8) AS l, coalesce(7 - max(i) FILTER (side = 'x' AND v > 8), 8) AS r,
  coalesce(min(i) FILTER (side = 'y' AND v > 8), 8) AS t, coalesce(7 - max(i) FILTER (side = 'y' AND v > 8), 8) AS b FROM pr GROUP BY ALL),
wa AS MATERIALIZED (SELECT ex.*, CASE WHEN lit < 0.25 THEN 'black_intro' WHEN 8 - l - r <= 0 OR 8 - t - b <= 0 OR 8 - l - r < 2 OR 8 - t - b < 2 THEN 'implausible_roi' END AS warning
  FROM ex JOIN (SELECT source_id, count(*) FILTER (v > 8) / count(*) AS lit FROM md GROUP BY ALL) USING (source_id)),
ar AS MATERIALIZED (SELECT source_id, CASE WHEN warning IS NULL THEN l ELSE 0 END AS x, CASE WHEN warning IS NULL THEN t ELSE 0 END AS y,
  CASE WHEN warning IS NULL THEN 8 - l - r ELSE 8 END AS width, CASE WHEN warning IS NULL THEN 8 - t - b ELSE 8 END AS height, warning FROM wa)
"""


def a05_pixel_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roi.pixel_median(bordered(spark, sf_dir)).select("source_id", "y", "x", "v")


def a06_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roi.profiles(roi.median_images(bordered(spark, sf_dir)))


def a07_automatic_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roi.automatic_roi(bordered(spark, sf_dir))


def p08_resolve_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displays of 20 x 13 over caches of 8 x 8; sources 1 and 4 are manual, 7 is full, all others automatic."""
    frames = bordered(spark, sf_dir)
    label = F.col("source_id").cast("int")
    manual = F.struct(F.lit(2).alias("x"), label.alias("y"), F.lit(7).alias("width"), F.lit(5).alias("height"))
    sources = frames.select("source_id").distinct().select("source_id", F.when(label.isin(1, 4), "manual").when(label == 7, "full").otherwise("auto").alias("roi_mode"), manual.alias("manual_roi"), F.lit(20).alias("display_w"), F.lit(13).alias("display_h"), F.lit(8).alias("cache_w"), F.lit(8).alias("cache_h"))
    got = roi.resolve_roi(sources, roi.automatic_roi(frames, 1), roi.automatic_roi(frames))
    return got.select("source_id", F.col("roi.x").alias("x"), F.col("roi.y").alias("y"), F.col("roi.width").alias("width"), F.col("roi.height").alias("height"), "roi_origin", "warning")


_ONE = BORDERED_SQL.replace("ordinal < 8", "ordinal < 1")
for _name in ("p8", "md", "pr", "ex", "wa", "ar"):
    _ONE = _ONE.replace(f"{_name} AS MATERIALIZED", f"{_name}_1 AS MATERIALIZED").replace(f"FROM {_name} ", f"FROM {_name}_1 ")
_ONE = _ONE.replace("ex.*", "ex_1.*")


def o01_first_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roi.first_rows(fx.frames(spark, sf_dir).select("source_id", "ordinal", "pts"), 8)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = Window.partitionBy("source_id").orderBy("ordinal")
    ok = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ~((i % 8 >= 6) & (i < 24) & (F.col("source_id").cast("int") % 2 == 1)))
    frames = fx.frames(spark, sf_dir).withColumn("other", F.lag("px").over(before)).where("ordinal > 0")
    return frames.select("source_id", "ordinal", "width", "height", "px", "other", ok.alias("ok"))


def a04_local_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring frames; the odd sources have a masked corner."""
    got = changes.local_changes(_pairs(spark, sf_dir), fx.SMALL_ANCHOR)
    return got.select("source_id", "ordinal", "global_sum", "valid", "changed", "max_sum", "max_count", "tile_x", "tile_y", "eligible", changes.anchor_hit(fx.SMALL_ANCHOR).alias("hit"))


def w08_anchor_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = fx.frames(spark, sf_dir)
    samples = fx.timed_samples(frames, fx.frame_sources(frames)).select("source_id", "ordinal", "ticks")
    return anchor.anchor_groups(frames.join(samples, ["source_id", "ordinal"]), fx.SMALL_ANCHOR)


def w08_speculative_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over pieces of twelve frames, each folded by a task of its own and stitched."""
    frames = fx.frames(spark, sf_dir)
    samples = fx.timed_samples(frames, fx.frame_sources(frames)).select("source_id", "ordinal", "ticks")
    return anchor.speculative_groups(frames.join(samples, ["source_id", "ordinal"]), fx.SMALL_ANCHOR, 12)


def w02_order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order whose ship date does not come after that of the line before."""
    rows = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("source_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("place"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"))
    return checks.out_of_order(rows, "day", "place").select("source_id", "line", "part", "day", F.col("prev_value").alias("prev_day"))


def w07_broken_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers that are not their place in their order."""
    rows = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("source_id"), (F.col("l_linenumber") - 1).alias("ordinal"), F.col("l_partkey").alias("part"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("place_by"))
    return checks.broken_ordinals(rows, "place_by").select("source_id", "ordinal", "part", "place")


QUERIES = {f.__name__: f for f in (a05_pixel_median, a06_profiles, a07_automatic_roi, p08_resolve_roi, o01_first_samples, a04_local_change, w08_anchor_detector, w08_speculative_anchor, w02_order_violations, w07_broken_ordinals)}

_F = fx.FRAMES_SQL
#: Differences of all pairs of frames of a source (pairs: which), whole and by overlapping tiles.
_DIFFS = """
df AS MATERIALIZED (SELECT a.source_id, a.ordinal AS i, b.ordinal AS j, a.y, a.x, abs(a.v - b.v) AS dv FROM p a JOIN p b ON a.source_id = b.source_id AND a.y = b.y AND a.x = b.x AND a.ordinal < b.ordinal),
tl AS MATERIALIZED (SELECT source_id, i, j, max(total) AS max_sum FROM (SELECT source_id, i, j, oy, ox, sum(dv) AS total FROM df, (VALUES (0), (2), (4)) ys(oy), (VALUES (0), (2), (4)) xs(ox)
  WHERE y BETWEEN oy AND oy + 3 AND x BETWEEN ox AND ox + 3 GROUP BY ALL) GROUP BY source_id, i, j),
hi AS MATERIALIZED (SELECT source_id, i, j, count(*) FILTER (dv > 60) >= CAST(0.171875 AS DOUBLE) * 64 AND (sum(dv) >= CAST(0.14 AS DOUBLE) * 255 * 64 OR any_value(max_sum) >= CAST(0.19 AS DOUBLE) * 255 * 16) AS hit
  FROM df JOIN tl USING (source_id, i, j) GROUP BY source_id, i, j)
"""
_FOLD = """
nx AS MATERIALIZED (SELECT source_id, ordinal, ticks, max(ordinal) OVER (PARTITION BY source_id) AS last, lag(ticks) OVER w1 AS before, lead(ticks) OVER w1 AS after FROM s WINDOW w1 AS (PARTITION BY source_id ORDER BY ordinal)),
st AS (
  SELECT source_id, 0 AS i, 0 AS anchor, CAST(NULL AS INT) AS suppressed, 0 AS first, 0 AS stable, CAST(NULL AS INT) AS old_first, CAST(NULL AS INT) AS old_stable, CAST(NULL AS VARCHAR) AS status, last FROM nx WHERE ordinal = 0
  UNION ALL
  SELECT source_id, ordinal, CASE WHEN status IS NOT NULL THEN ordinal ELSE anchor END,
    CASE WHEN ordinal = last THEN suppressed WHEN status IS NOT NULL THEN NULL WHEN h1 THEN ordinal WHEN NOT h5 THEN NULL ELSE suppressed END,
    CASE WHEN status IS NOT NULL THEN ordinal ELSE first END, CASE WHEN status IS NOT NULL THEN ordinal WHEN NOT h1 AND NOT h5 THEN ordinal ELSE stable END, first, stable, status, last
  FROM (SELECT *, CASE WHEN h1 AND ordinal = last AND (suppressed IS NULL OR h2) THEN 'eof_unconfirmed' WHEN h1 AND ordinal < last AND soon AND h3 AND NOT h4 THEN 'confirmed' END AS status FROM (
    SELECT st.source_id, nx.ordinal, st.anchor, st.suppressed, st.first, st.stable, st.last, coalesce(a.hit, false) AS h1, coalesce(b.hit, false) AS h2, coalesce(c.hit, false) AS h3, coalesce(d4.hit, false) AS h4, coalesce(e5.hit, false) AS h5,
      2 * (nx.after - nx.ticks) <= 3 * (nx.ticks - nx.before) AS soon
    FROM st JOIN nx ON nx.source_id = st.source_id AND nx.ordinal = st.i + 1
    LEFT JOIN hi a ON a.source_id = st.source_id AND a.i = st.anchor AND a.j = nx.ordinal
    LEFT JOIN hi b ON b.source_id = st.source_id AND b.i = st.suppressed AND b.j = nx.ordinal
    LEFT JOIN hi c ON c.source_id = st.source_id AND c.i = st.anchor AND c.j = nx.ordinal + 1
    LEFT JOIN hi d4 ON d4.source_id = st.source_id AND d4.i = nx.ordinal AND d4.j = nx.ordinal + 1
    LEFT JOIN hi e5 ON e5.source_id = st.source_id AND e5.i = nx.ordinal - 1 AND e5.j = nx.ordinal))),
gr AS (SELECT source_id, old_first AS first_ordinal, i - 1 AS last_ordinal, greatest(old_first, old_stable) AS rep_ordinal FROM st WHERE status IS NOT NULL
  UNION ALL SELECT source_id, first, last, greatest(first, stable) FROM st WHERE i = last),
op AS (SELECT source_id, i, status, CASE status WHEN 'confirmed' THEN 2 ELSE 1 END AS persistence FROM st WHERE status IS NOT NULL)
"""
SQL = {
    "a05_pixel_median": fx.sql("SELECT * FROM md", _F, BORDERED_SQL),
    "a06_profiles": fx.sql("SELECT * FROM pr", _F, BORDERED_SQL),
    "a07_automatic_roi": fx.sql("SELECT * FROM ar", _F, BORDERED_SQL),
    "p08_resolve_roi": fx.sql(
        """SELECT source_id, CASE WHEN m = 'full' THEN 0 WHEN m = 'manual' THEN 2 WHEN w1 IS NULL THEN x1 * 20 // 8 ELSE x2 * 20 // 8 END AS x,
        CASE WHEN m = 'full' THEN 0 WHEN m = 'manual' THEN CAST(source_id AS INT) WHEN w1 IS NULL THEN y1 * 13 // 8 ELSE y2 * 13 // 8 END AS y,
        CASE WHEN m = 'full' THEN 20 WHEN m = 'manual' THEN 7 WHEN w1 IS NULL THEN least(20, ((x1 + u1) * 20 + 7) // 8) - x1 * 20 // 8 ELSE least(20 - x2 * 20 // 8, (u2 * 20 + 7) // 8) END AS width,
        CASE WHEN m = 'full' THEN 13 WHEN m = 'manual' THEN 5 WHEN w1 IS NULL THEN least(13, ((y1 + v1) * 13 + 7) // 8) - y1 * 13 // 8 ELSE least(13 - y2 * 13 // 8, (v2 * 13 + 7) // 8) END AS height,
        CASE WHEN m <> 'auto' THEN m WHEN w1 IS NULL THEN 'first_frame' ELSE 'first_frames' END AS roi_origin, CASE WHEN m = 'auto' AND w1 IS NOT NULL THEN w2 END AS warning
        FROM (SELECT source_id, CASE WHEN source_id IN ('1', '4') THEN 'manual' WHEN source_id = '7' THEN 'full' ELSE 'auto' END AS m, a.x AS x1, a.y AS y1, a.width AS u1, a.height AS v1, a.warning AS w1,
        b.x AS x2, b.y AS y2, b.width AS u2, b.height AS v2, b.warning AS w2 FROM ar_1 a JOIN ar b USING (source_id))""",
        _F, BORDERED_SQL, _ONE,
    ),
    "o01_first_samples": fx.sql("SELECT * FROM k WHERE ordinal < 8", _F),
    "a04_local_change": fx.sql(
        """, dd AS (SELECT a.source_id, b.ordinal, a.y, a.x, abs(a.v - b.v) AS dv, NOT (a.x >= 6 AND a.y < 3 AND CAST(a.source_id AS INT) % 2 = 1) AS ok FROM p a JOIN p b ON a.source_id = b.source_id AND a.y = b.y AND a.x = b.x AND a.ordinal + 1 = b.ordinal),
        tt AS (SELECT source_id, ordinal, oy, ox, coalesce(sum(dv) FILTER (ok), 0) AS total, count(*) FILTER (ok) AS n FROM dd, (VALUES (0), (2), (4)) ys(oy), (VALUES (0), (2), (4)) xs(ox) WHERE y BETWEEN oy AND oy + 3 AND x BETWEEN ox AND ox + 3 GROUP BY ALL),
        bb AS (SELECT *, row_number() OVER (PARTITION BY source_id, ordinal ORDER BY total * 720720 // n DESC, oy, ox) AS place, count(*) OVER (PARTITION BY source_id, ordinal) AS eligible FROM tt WHERE 2 * n >= 16),
        gg AS (SELECT source_id, ordinal, CAST(sum(dv) FILTER (ok) AS BIGINT) AS global_sum, count(*) FILTER (ok) AS valid, count(*) FILTER (ok AND dv > 60) AS changed FROM dd GROUP BY ALL)
        SELECT source_id, ordinal, global_sum, valid, changed, CAST(total AS BIGINT) AS max_sum, n AS max_count, ox AS tile_x, oy AS tile_y, eligible,
        changed >= CAST(0.171875 AS DOUBLE) * valid AND (global_sum >= CAST(0.14 AS DOUBLE) * 255 * valid OR total >= CAST(0.19 AS DOUBLE) * 255 * n) AS hit FROM gg JOIN bb USING (source_id, ordinal) WHERE place = 1""",
        _F,
    ),
    "w08_anchor_detector": fx.sql(
        """SELECT gr.source_id, CAST(row_number() OVER (PARTITION BY gr.source_id ORDER BY first_ordinal) - 1 AS INT) AS group_ix, first_ordinal, last_ordinal, rep_ordinal, ticks AS start_ticks, status, persistence
        FROM gr JOIN s ON s.source_id = gr.source_id AND s.ordinal = gr.first_ordinal LEFT JOIN op ON op.source_id = gr.source_id AND op.i = gr.first_ordinal""",
        _F, _DIFFS, _FOLD,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "w02_order_violations": """SELECT source_id, line, part, day, prev_day FROM (SELECT CAST(l_orderkey AS VARCHAR) AS source_id, l_linenumber AS line, l_partkey AS part, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS day,
        lag(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS prev_day FROM lineitem) WHERE day <= prev_day""",
    "w07_broken_ordinals": """SELECT * FROM (SELECT CAST(l_orderkey AS VARCHAR) AS source_id, l_linenumber - 1 AS ordinal, l_partkey AS part, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS INT) AS place FROM lineitem) WHERE place <> ordinal""",
}
SQL["a04_local_change"] = SQL["a04_local_change"].replace("\n,", ",", 1)
SQL["w08_speculative_anchor"] = SQL["w08_anchor_detector"]
