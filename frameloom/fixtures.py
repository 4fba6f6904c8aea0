"""How the test tables stand in for frames, packets, sources, jobs and so on.

Each function reads one of the given tables and derives rows of this library's tables from it with Spark; the SQL
texts beside them derive the same in DuckDB, for the comparison of every registered query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .settings import AnchorSettings, SpatialSettings

#: Frames of 8 x 8 pixels need smaller tiles and larger thresholds; the shares are exact in binary.
SMALL = SpatialSettings(pixel_delta=60, edge_delta=60, tile=2, cell_changed_fraction=0.5, changed_fraction=0.1875, cell_fraction=0.1875, overlay_missing_edges=1)
SMALL_ANCHOR = AnchorSettings(mad=0.14, tile_mad=0.19, pixel_delta=60, changed_fraction=0.171875, tile=4, stride=2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, ordinal, pts, width, height, px): one source a label of ``embeddings``, 8 x 8 gray frames."""
    numbered = table(spark, sf_dir, "embeddings").withColumn("ordinal", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("int"))
    gray = F.transform("embedding", lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 0.5) * 255).cast("int"))).cast("short"))
    return numbered.select(F.col("label").cast("string").alias("source_id"), "ordinal", (1000 * F.col("ordinal") + F.col("vec_id") % 500).cast("long").alias("pts"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.slice(gray, 1, 64).alias("px"))


def frame_sources(samples: DataFrame) -> DataFrame:
    """(source_id, origin_pts, duration_ticks, tb_num, tb_den) of frames: 1000 ticks follow the last frame."""
    by = samples.groupBy("source_id").agg(F.min("pts").alias("origin_pts"), F.max("pts").alias("last_pts"))
    return by.select("source_id", "origin_pts", (F.col("last_pts") - F.col("origin_pts") + 1000).alias("duration_ticks"), F.lit(1).cast("long").alias("tb_num"), F.lit(1000).cast("long").alias("tb_den"))


def timed_samples(frame_rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, ordinal, pts, ticks) of frames."""
    return frame_rows.select("source_id", "ordinal", "pts").join(sources.select("source_id", "origin_pts"), "source_id").select("source_id", "ordinal", "pts", (F.col("pts") - F.col("origin_pts")).alias("ticks"))


#: f: frames; p: one row a pixel; s: samples with their ticks; d: sources.
FRAMES_SQL = """
f AS MATERIALIZED (SELECT CAST(label AS VARCHAR) AS source_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS ordinal, vec_id, embedding FROM embeddings),
p AS MATERIALIZED (SELECT source_id, ordinal, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x,
  least(255, greatest(0, CAST(floor((CAST(embedding[i] AS DOUBLE) + 0.5) * 255) AS INT))) AS v FROM f, range(1, 65) t(i)),
k AS MATERIALIZED (SELECT source_id, ordinal, CAST(1000 * ordinal + vec_id % 500 AS BIGINT) AS pts FROM f),
d AS MATERIALIZED (SELECT source_id, min(pts) AS origin_pts, max(pts) - min(pts) + 1000 AS duration_ticks FROM k GROUP BY source_id),
s AS MATERIALIZED (SELECT source_id, ordinal, pts, pts - origin_pts AS ticks FROM k JOIN d USING (source_id))
"""

#: e: edges; c: tile changes; m: pair changes; n: segment numbers; b: segment bounds (after FRAMES_SQL).
SEGMENTS_SQL = """
e AS MATERIALIZED (SELECT p.source_id, p.ordinal, p.y, p.x, p.v, coalesce(abs(p.v - l.v) > 60, false) OR coalesce(abs(p.v - u.v) > 60, false) AS edge FROM p
  LEFT JOIN p l ON l.source_id = p.source_id AND l.ordinal = p.ordinal AND l.y = p.y AND l.x = p.x - 1
  LEFT JOIN p u ON u.source_id = p.source_id AND u.ordinal = p.ordinal AND u.x = p.x AND u.y = p.y - 1),
c AS MATERIALIZED (SELECT p.source_id, p.ordinal, p.y // 2 AS ty, p.x // 2 AS tx, CAST(count(*) AS INT) AS valid, CAST(count(*) FILTER (abs(p.v - q.v) > 60) AS INT) AS changed
  FROM p JOIN p q ON p.source_id = q.source_id AND p.ordinal = q.ordinal + 1 AND p.y = q.y AND p.x = q.x GROUP BY ALL),
m AS MATERIALIZED (SELECT source_id, ordinal, CAST(sum(valid) AS BIGINT) AS valid, CAST(sum(changed) AS BIGINT) AS changed, count(*) FILTER (changed / valid >= 0.5) AS changed_cells, count(*) AS cells,
  sum(changed) / sum(valid) AS changed_fraction, count(*) FILTER (changed / valid >= 0.5) / count(*) AS cell_fraction FROM c GROUP BY source_id, ordinal),
n AS MATERIALIZED (SELECT s.*, coalesce(changed_fraction >= 0.1875 AND cell_fraction >= 0.1875, false) AS is_boundary,
  CAST(sum(CASE WHEN changed_fraction >= 0.1875 AND cell_fraction >= 0.1875 THEN 1 ELSE 0 END) OVER (PARTITION BY s.source_id ORDER BY s.ordinal) AS INT) AS segment_ix FROM s LEFT JOIN m ON s.source_id = m.source_id AND s.ordinal = m.ordinal),
b AS MATERIALIZED (SELECT source_id, segment_ix, first_ordinal, last_ordinal, CASE WHEN segment_ix = 0 THEN 0 ELSE first_ticks END AS start_ticks,
  coalesce(lead(first_ticks) OVER (PARTITION BY source_id ORDER BY segment_ix), duration_ticks) AS end_ticks, CASE WHEN segment_ix > 0 THEN segment_ix - 1 END AS start_boundary_ix
  FROM (SELECT source_id, segment_ix, min(ordinal) AS first_ordinal, max(ordinal) AS last_ordinal, min(ticks) AS first_ticks FROM n GROUP BY source_id, segment_ix) JOIN d USING (source_id))
"""

#: r: representatives with their diagnostics; g: automatic pages with times (after SEGMENTS_SQL).
REPRESENTATIVES_SQL = """
h AS MATERIALIZED (SELECT e.*, n.segment_ix FROM e JOIN n USING (source_id, ordinal)),
z AS MATERIALIZED (SELECT source_id, segment_ix, y, x, max(v) AS top, count(*) AS n_frames, count(*) FILTER (edge) AS n_edges FROM h GROUP BY ALL),
q AS MATERIALIZED (SELECT h.*, z.top - h.v > 60 AS mark, z.n_frames, z.n_edges FROM h JOIN z USING (source_id, segment_ix, y, x)),
u AS MATERIALIZED (SELECT source_id, segment_ix, y, x, any_value(n_frames) AS n_frames, count(*) FILTER (mark) >= least(2, any_value(n_frames)) AS supported,
  any_value(n_edges) >= greatest(1, ceil(any_value(n_frames) * CAST(0.6 AS DOUBLE))) AS core FROM q GROUP BY ALL),
w AS MATERIALIZED (SELECT q.source_id, q.segment_ix, q.ordinal, q.y // 2 AS ty, q.x // 2 AS tx, count(*) AS valid, count(*) FILTER (mark) AS marked, count(*) FILTER (core AND NOT edge) AS lost,
  count(*) FILTER (mark AND supported) AS retained, count(*) FILTER (mark AND NOT supported) AS transient, count(*) FILTER (supported AND NOT mark) AS missing
  FROM q JOIN u USING (source_id, segment_ix, y, x) GROUP BY ALL),
v AS MATERIALIZED (SELECT * FROM w WHERE marked / valid >= 0.25 AND lost >= 1),
o AS MATERIALIZED (SELECT source_id, segment_ix, ordinal, count(*) AS occluded FROM v WHERE EXISTS (SELECT 1 FROM v t WHERE t.source_id = v.source_id AND t.segment_ix = v.segment_ix AND t.ordinal = v.ordinal
  AND abs(t.ty - v.ty) + abs(t.tx - v.tx) = 1) GROUP BY ALL),
a AS MATERIALIZED (SELECT w.source_id, w.segment_ix, w.ordinal, CAST(sum(retained) AS BIGINT) AS retained, CAST(sum(transient) AS BIGINT) AS transient, CAST(sum(missing) AS BIGINT) AS missing, coalesce(any_value(occluded), 0) AS occluded
  FROM w LEFT JOIN o USING (source_id, segment_ix, ordinal) GROUP BY ALL),
r AS MATERIALIZED (SELECT source_id, segment_ix, ordinal AS rep_ordinal, missing AS missing_supported, retained AS retained_supported, occluded AS occlusion_tiles
  FROM (SELECT *, row_number() OVER (PARTITION BY source_id, segment_ix ORDER BY occluded, retained - 0.25 * transient DESC, ordinal DESC) AS place FROM a) WHERE place = 1),
g AS MATERIALIZED (SELECT r.source_id, substr(sha256(r.source_id || '/auto/' || CAST(segment_ix AS VARCHAR)), 1, 32) AS page_id, rep_ordinal, segment_ix, ticks FROM r JOIN s ON s.source_id = r.source_id AND s.ordinal = r.rep_ordinal)
"""


def sql(body: str, *parts: str) -> str:
    return "WITH " + ",".join(p.strip() for p in (*parts, "")).rstrip(",") + "\n" + body.strip()
