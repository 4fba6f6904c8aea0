"""Registered queries over edits of the pages of ``embeddings``' frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixtures as fx
from ..operators import lookups, pages
from . import frame_queries
from .staging import staged


class Fixture:
    """Pages, samples and segments of the frames, written once: what an editor starts from."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        found = frame_queries.analysis(spark, sf_dir)
        frames = fx.frames(spark, sf_dir)
        self.samples = staged(fx.timed_samples(frames, fx.frame_sources(frames)))
        self.segments = staged(found.bounds)
        self.pages = staged(found.pages.select(*pages.PAGE))

    def ranked(self) -> DataFrame:
        return self.pages.withColumn("at", F.row_number().over(pages.by_time())).withColumn("next_id", F.lead("page_id").over(pages.by_time()))


def _edit(rows: DataFrame, kind: str, seq, ids=None, num=None, den: int = 1) -> DataFrame:
    none = F.lit(None)
    return rows.select("source_id", seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), (ids if ids is not None else none.cast("array<string>")).alias("page_ids"), (num.cast("long") if num is not None else none.cast("long")).alias("at_num"), (F.lit(den).cast("long") if num is not None else none.cast("long")).alias("at_den"))


def adds(f: Fixture) -> DataFrame:
    """Per source: one add at a third of the time line, one half-way between its samples 3 and 4, and one onto a page."""
    last = f.samples.groupBy("source_id").agg(F.max("ticks").alias("ticks"))
    next_ = F.lead("ticks").over(Window.partitionBy("source_id").orderBy("ordinal"))
    tie = f.samples.withColumn("n", next_).where("ordinal = 3")
    own = f.ranked().where("at = 2")
    return _edit(last, "add", F.lit(1), num=F.col("ticks"), den=3).union(_edit(tie, "add", F.lit(2), num=F.col("ticks") + F.col("n"), den=2)).union(_edit(own, "add", F.lit(3), num=F.col("ticks")))


def changeless(f: Fixture) -> DataFrame:
    """Replaces that change nothing: the second page onto the third's sample, one of an unknown page, and the first onto itself."""
    onto = f.ranked().withColumn("next_ticks", F.lead("ticks").over(pages.by_time())).where("at = 2 AND next_ticks IS NOT NULL")
    first = f.ranked().where("at = 1")
    ids = F.array("page_id")
    return (
        _edit(onto, "replace", F.lit(1000), ids, F.col("next_ticks"))
        .union(_edit(first, "replace", F.lit(1001), F.array(F.lit("nobody")), F.col("ticks")))
        .union(_edit(first, "replace", F.lit(1002), ids, F.col("ticks")))
    )


def replaces(f: Fixture) -> DataFrame:
    """Every ninth page moves by 700 ticks (page 990 in an edit with the number of one of the others), and those that change nothing."""
    every = f.ranked().where("at % 9 = 0")
    return _edit(every, "replace", 10 + F.col("at"), F.array("page_id"), F.col("ticks") + 700).union(changeless(f))


def moves(f: Fixture) -> DataFrame:
    """The replaces that change nothing, and the fourth page by 700 ticks."""
    return changeless(f).union(_edit(f.ranked().where("at = 4"), "replace", F.lit(1003), F.array("page_id"), F.col("ticks") + 700))


def deletes(f: Fixture) -> DataFrame:
    """Even sources delete every fifth page; source 1 names an unknown one too; source 3 chooses nothing."""
    label = F.col("source_id").cast("int")
    some = f.ranked().where((F.col("at") % 5 == 0) & ((label % 2 == 0) | (label == 1))).groupBy("source_id").agg(F.sort_array(F.collect_list("page_id")).alias("ids"))
    some = some.withColumn("ids", F.when(label == 1, F.concat("ids", F.array(F.lit("nobody")))).otherwise(F.col("ids")))
    none = f.samples.where("source_id = '3' AND ordinal = 0")
    return _edit(some, "delete", F.lit(20), F.col("ids")).union(_edit(none, "delete", F.lit(20), F.expr("CAST(array() AS ARRAY<STRING>)")))


def merges(f: Fixture) -> DataFrame:
    """Every seventh page is merged with the next one (all in one edit); source 5 chooses one page only, source 7 an unknown one."""
    label = F.col("source_id").cast("int")
    some = f.ranked().where("at % 7 = 0 AND next_id IS NOT NULL").groupBy("source_id").agg(F.flatten(F.sort_array(F.collect_list(F.array("page_id", "next_id")))).alias("ids"))
    some = some.withColumn("ids", F.when(label == 5, F.slice("ids", 1, 1)).when(label == 7, F.concat("ids", F.array(F.lit("nobody")))).otherwise(F.col("ids")))
    return _edit(some, "merge", F.lit(30), F.col("ids"))


def _pages(rows: DataFrame) -> DataFrame:
    return rows.select("source_id", "page_id", "rep_ordinal", "ticks", "origin", "derived_segment_ix", "last_edit")


def j01_sample_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Fixture(spark, sf_dir)
    return lookups.sample_times(f.pages.select("source_id", "page_id", "rep_ordinal"), f.samples)


def e01_add_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Fixture(spark, sf_dir)
    return _pages(pages.add_pages(f.pages, pages.resolve(adds(f), f.samples, f.segments))[0])


def e01_add_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Fixture(spark, sf_dir)
    return pages.add_pages(f.pages, pages.resolve(adds(f), f.samples, f.segments))[1].drop("focus")


def e02_replace_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Fixture(spark, sf_dir)
    return _pages(pages.replace_pages(f.pages, pages.resolve(replaces(f), f.samples, f.segments))[0])


def e02_replace_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Fixture(spark, sf_dir)
    return pages.replace_pages(f.pages, pages.resolve(replaces(f), f.samples, f.segments))[1].drop("focus")


def e03_delete_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page a source, the last."""
    f = Fixture(spark, sf_dir)
    last = f.ranked().where("next_id IS NULL")
    return _pages(pages.delete_pages(f.pages, _edit(last, "delete", F.lit(1), F.array("page_id")))[0])


def e04_delete_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Fixture(spark, sf_dir)
    return _pages(pages.delete_pages(f.pages, deletes(f))[0])


def o05_focus_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Fixture(spark, sf_dir)
    return pages.delete_pages(f.pages, deletes(f))[1]


def e05_merge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Fixture(spark, sf_dir)
    return _pages(pages.merge_pages(f.pages, merges(f))[0])


def o03_latest_of_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Fixture(spark, sf_dir)
    return pages.latest_of(f.pages, f.ranked().where("at % 4 = 1").select("source_id", "page_id"))


def o02_chronological_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import segments

    f = Fixture(spark, sf_dir)
    return segments.ranked(f.pages).select("source_id", "page", "page_id", "ticks")


def o04_navigate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every page by +2, -3 and, as an unknown page, +1."""
    f = Fixture(spark, sf_dir)
    moves = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(d).alias("d")) for k, d in ((0, 2), (1, -3), (2, 1))))).alias("m")
    steps = f.ranked().select("source_id", "at", "page_id", moves).select("source_id", (F.col("at") * 10 + F.col("m.k")).alias("step"), F.when(F.col("m.k") < 2, F.col("page_id")).otherwise("nobody").alias("current"), F.col("m.d").alias("delta"))
    return pages.navigate(f.pages, steps)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Fixture(spark, sf_dir)
    log = adds(f).union(deletes(f)).union(merges(f)).union(moves(f))
    return pages.replay(f.pages, pages.resolve(log, f.samples, f.segments))


def e06_replay_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds, deletes, merges and replaces in one log; the same as the four one after the other."""
    return _pages(_log(spark, sf_dir).where("row = 'page'"))


def e06_replay_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).where("row = 'outcome'").select("source_id", "seq", "status", "code", "revision")


QUERIES = {f.__name__: f for f in (j01_sample_lookup, e01_add_pages, e01_add_outcomes, e02_replace_pages, e02_replace_outcomes, e03_delete_page, e04_delete_pages, o05_focus_after_delete, e05_merge_pages, o03_latest_of_selection, o02_chronological_pages, o04_navigate, e06_replay_pages, e06_replay_outcomes)}

_PG = """
pa AS MATERIALIZED (SELECT g.source_id, page_id, rep_ordinal, ticks, 'auto' AS origin, segment_ix AS derived_segment_ix, CAST(NULL AS VARCHAR) AS last_edit, row_number() OVER w1 AS pos, lead(page_id) OVER w1 AS next_id, lead(ticks) OVER w1 AS next_ticks
  FROM g WINDOW w1 AS (PARTITION BY g.source_id ORDER BY ticks)),
aq AS MATERIALIZED (SELECT source_id, 1 AS seq, max(ticks) AS num, 3 AS den FROM s GROUP BY 1 UNION ALL SELECT source_id, 2, ticks + nx, 2 FROM (SELECT *, lead(ticks) OVER (PARTITION BY source_id ORDER BY ordinal) AS nx FROM s) WHERE ordinal = 3
  UNION ALL SELECT source_id, 3, ticks, 1 FROM pa WHERE pos = 2),
rq AS MATERIALIZED (SELECT source_id, 10 + pos AS seq, page_id, ticks + 700 AS num, 1 AS den FROM pa WHERE pos % 9 = 0 UNION ALL SELECT source_id, 1000, page_id, next_ticks, 1 FROM pa WHERE pos = 2 AND next_ticks IS NOT NULL
  UNION ALL SELECT source_id, 1001, 'nobody', ticks, 1 FROM pa WHERE pos = 1 UNION ALL SELECT source_id, 1002, page_id, ticks, 1 FROM pa WHERE pos = 1),
nq AS MATERIALIZED (SELECT q.*, s.ordinal AS o, s.ticks AS t FROM (SELECT source_id, seq, 'a' AS kind, num, den FROM aq UNION ALL SELECT source_id, seq, 'r', num, den FROM rq) q JOIN s ON s.source_id = q.source_id
  QUALIFY row_number() OVER (PARTITION BY q.source_id, q.kind, q.seq ORDER BY abs(num - s.ticks * den), s.ticks) = 1),
nr AS MATERIALIZED (SELECT nq.*, n.segment_ix AS seg FROM nq JOIN n ON n.source_id = nq.source_id AND n.ordinal = nq.o),
ad AS MATERIALIZED (SELECT nr.*, pa.page_id AS there, row_number() OVER (PARTITION BY nr.source_id, o ORDER BY seq) AS rank FROM nr LEFT JOIN pa ON pa.source_id = nr.source_id AND pa.rep_ordinal = nr.o WHERE kind = 'a'),
pb AS MATERIALIZED (SELECT source_id, page_id, rep_ordinal, ticks, origin, derived_segment_ix, last_edit FROM pa UNION ALL
  SELECT source_id, substr(sha256(source_id || '/manual/' || seq || '/' || o), 1, 32), o, t, 'manual', seg, 'add' FROM ad WHERE there IS NULL AND rank = 1),
rp AS MATERIALIZED (SELECT *, CASE WHEN rep_ordinal IS NULL THEN 'UnknownPage' WHEN rep_ordinal = o THEN 'SameSample' WHEN holder IS NOT NULL OR rank > 1 THEN 'DuplicateSample' END AS code FROM (
  SELECT nr.*, rq.page_id, me.rep_ordinal, hd.page_id AS holder, row_number() OVER (PARTITION BY nr.source_id, o ORDER BY nr.seq) AS rank FROM nr JOIN rq USING (source_id, seq)
  LEFT JOIN pa me ON me.source_id = nr.source_id AND me.page_id = rq.page_id LEFT JOIN pa hd ON hd.source_id = nr.source_id AND hd.rep_ordinal = nr.o WHERE kind = 'r')),
dl AS MATERIALIZED (SELECT source_id, page_id, pos FROM pa WHERE pos % 5 = 0 AND CAST(source_id AS INT) % 2 = 0),
ml AS MATERIALIZED (SELECT source_id, page_id FROM pa a WHERE pos % 7 = 0 AND next_id IS NOT NULL UNION SELECT source_id, next_id FROM pa WHERE pos % 7 = 0 AND next_id IS NOT NULL)
"""
_ALL = (fx.FRAMES_SQL, fx.SEGMENTS_SQL, fx.REPRESENTATIVES_SQL, _PG)
_COLS = "source_id, page_id, rep_ordinal, ticks, origin, derived_segment_ix, last_edit"
#: What the log of adds, deletes, merges and replaces does: pd, pm: pages after the deletes and merges; mo: the move of the fourth page; dj, mj, rj: outcomes.
_ADDED = "SELECT source_id, CAST(seq AS BIGINT) AS seq, CASE WHEN there IS NULL AND rank = 1 THEN 'changed' ELSE 'no_op' END AS status, CASE WHEN NOT (there IS NULL AND rank = 1) THEN 'AlreadySelected' END AS code FROM ad"
_DELETED = """
pd AS MATERIALIZED (SELECT {cols} FROM pb WHERE NOT EXISTS (SELECT 1 FROM dl WHERE dl.source_id = pb.source_id AND dl.page_id = pb.page_id)),
ed AS MATERIALIZED (SELECT DISTINCT source_id FROM pa WHERE pos % 5 = 0 AND (CAST(source_id AS INT) % 2 = 0 OR source_id = '1') UNION SELECT '3'),
dj AS MATERIALIZED (SELECT source_id, CAST(20 AS BIGINT) AS seq, CASE source_id WHEN '3' THEN 'no_op' WHEN '1' THEN 'rejected' ELSE 'changed' END AS status, CASE source_id WHEN '3' THEN 'EmptySelection' WHEN '1' THEN 'UnknownPage' END AS code FROM ed)
"""
_LOG_MERGED = """
ok AS MATERIALIZED (SELECT source_id FROM ml LEFT JOIN pd USING (source_id, page_id) GROUP BY source_id HAVING count(*) = count(pd.ticks)),
pm AS MATERIALIZED ({merged}),
mj AS MATERIALIZED (SELECT DISTINCT source_id, CAST(30 AS BIGINT) AS seq, CASE WHEN source_id = '5' THEN 'no_op' WHEN source_id = '7' OR source_id NOT IN (SELECT source_id FROM ok) THEN 'rejected' ELSE 'changed' END AS status,
  CASE WHEN source_id = '5' THEN 'NeedMultiplePages' WHEN source_id = '7' OR source_id NOT IN (SELECT source_id FROM ok) THEN 'UnknownPage' END AS code FROM ml)
"""
_MOVED = """
mr AS MATERIALIZED (SELECT pa.source_id, pa.page_id, s.ordinal AS o, s.ticks AS t FROM pa JOIN s ON s.source_id = pa.source_id WHERE pos = 4 QUALIFY row_number() OVER (PARTITION BY pa.source_id ORDER BY abs(pa.ticks + 700 - s.ticks), s.ticks) = 1),
mo AS MATERIALIZED (SELECT mr.*, n.segment_ix AS seg, CASE WHEN me.rep_ordinal = o THEN 'SameSample' WHEN hd.page_id IS NOT NULL THEN 'DuplicateSample' END AS code FROM mr JOIN n ON n.source_id = mr.source_id AND n.ordinal = o
  JOIN {t} me ON me.source_id = mr.source_id AND me.page_id = mr.page_id LEFT JOIN {t} hd ON hd.source_id = mr.source_id AND hd.rep_ordinal = o),
rj AS MATERIALIZED (SELECT source_id, CAST(seq AS BIGINT) AS seq, CASE WHEN code IS NULL THEN 'changed' WHEN code = 'SameSample' THEN 'no_op' ELSE 'rejected' END AS status, code FROM (SELECT source_id, 1003 AS seq, code FROM mo
  UNION ALL SELECT source_id, 1000, 'DuplicateSample' FROM pa WHERE pos = 2 AND next_ticks IS NOT NULL UNION ALL SELECT source_id, 1001, 'UnknownPage' FROM pa WHERE pos = 1 UNION ALL SELECT source_id, 1002, 'SameSample' FROM pa WHERE pos = 1))
"""
#: Merges of a page table (source_id, page_id, ticks): which pages go; sources 5 and 7 are left alone.
_MERGED = "SELECT {cols} FROM {t} t WHERE NOT EXISTS (SELECT 1 FROM ml JOIN {t} u USING (source_id, page_id) WHERE {ok} AND ml.source_id = t.source_id AND ml.page_id = t.page_id AND t.ticks < (SELECT max(v.ticks) FROM ml JOIN {t} v USING (source_id, page_id) WHERE ml.source_id = t.source_id))"
_REPLAY = (*_ALL, _DELETED.format(cols=_COLS), _LOG_MERGED.format(merged=_MERGED.format(cols=_COLS, t="pd", ok="ml.source_id NOT IN ('5', '7') AND ml.source_id IN (SELECT source_id FROM ok)")), _MOVED.format(t="pm"))
SQL = {
    "j01_sample_lookup": fx.sql("SELECT g.source_id, page_id, rep_ordinal, s.ticks, pts FROM g JOIN s ON s.source_id = g.source_id AND s.ordinal = rep_ordinal", *_ALL),
    "e01_add_pages": fx.sql(f"SELECT {_COLS} FROM pb", *_ALL),
    "e01_add_outcomes": fx.sql(_ADDED, *_ALL),
    "e02_replace_pages": fx.sql(
        """SELECT pa.source_id, pa.page_id, coalesce(m.o, pa.rep_ordinal) AS rep_ordinal, coalesce(m.t, ticks) AS ticks, origin, CASE WHEN m.o IS NULL THEN derived_segment_ix ELSE m.seg END AS derived_segment_ix, CASE WHEN m.o IS NULL THEN last_edit ELSE 'replace' END AS last_edit
        FROM pa LEFT JOIN (SELECT * FROM rp WHERE code IS NULL) m ON m.source_id = pa.source_id AND m.page_id = pa.page_id""",
        *_ALL,
    ),
    "e02_replace_outcomes": fx.sql("SELECT source_id, CAST(seq AS BIGINT) AS seq, CASE WHEN code IS NULL THEN 'changed' WHEN code = 'SameSample' THEN 'no_op' ELSE 'rejected' END AS status, code FROM rp", *_ALL),
    "e03_delete_page": fx.sql(f"SELECT {_COLS} FROM pa WHERE next_id IS NOT NULL", *_ALL),
    "e04_delete_pages": fx.sql(f"SELECT {_COLS} FROM pa WHERE NOT EXISTS (SELECT 1 FROM dl WHERE dl.source_id = pa.source_id AND dl.page_id = pa.page_id)", *_ALL),
    "o05_focus_after_delete": fx.sql(
        """, lf AS (SELECT source_id, page_id, row_number() OVER (PARTITION BY source_id ORDER BY ticks) AS r, count(*) OVER (PARTITION BY source_id) AS n FROM pa WHERE NOT EXISTS (SELECT 1 FROM dl WHERE dl.source_id = pa.source_id AND dl.page_id = pa.page_id)),
        fd AS (SELECT source_id, min(pos) AS first FROM dl GROUP BY 1), ed AS (SELECT DISTINCT source_id FROM pa WHERE pos % 5 = 0 AND (CAST(source_id AS INT) % 2 = 0 OR source_id = '1') UNION SELECT '3')
        SELECT source_id, CAST(20 AS BIGINT) AS seq, CASE source_id WHEN '3' THEN 'no_op' WHEN '1' THEN 'rejected' ELSE 'changed' END AS status, CASE source_id WHEN '3' THEN 'EmptySelection' WHEN '1' THEN 'UnknownPage' END AS code, page_id AS focus
        FROM ed LEFT JOIN fd USING (source_id) LEFT JOIN lf ON lf.source_id = ed.source_id AND first IS NOT NULL AND r = least(first, n)""".replace("SELECT source_id, CAST(20", "SELECT ed.source_id, CAST(20").replace("CASE source_id", "CASE ed.source_id"),
        *_ALL,
    ).replace("\n,", ",", 1),
    "e05_merge_pages": fx.sql(_MERGED.format(cols=_COLS, t="pa", ok="ml.source_id NOT IN ('5', '7')"), *_ALL),
    "o03_latest_of_selection": fx.sql("SELECT source_id, max_by(page_id, ticks) AS page_id FROM pa WHERE pos % 4 = 1 GROUP BY 1", *_ALL),
    "o02_chronological_pages": fx.sql("SELECT source_id, CAST(pos AS INT) AS page, page_id, ticks FROM pa", *_ALL),
    "o04_navigate": fx.sql(
        """SELECT source_id, CAST(a.pos * 10 + k AS INT) AS step, b.page_id FROM (SELECT x.*, k, d FROM (SELECT *, count(*) OVER (PARTITION BY source_id) AS n FROM pa) x, (VALUES (0, 2), (1, -3), (2, 1)) m(k, d)) a
        JOIN pa b USING (source_id) WHERE b.pos = greatest(1, least(n, CASE WHEN k = 2 THEN 1 ELSE a.pos END + d))""",
        *_ALL,
    ),
    "e06_replay_pages": fx.sql(
        """SELECT pm.source_id, pm.page_id, coalesce(m.o, rep_ordinal) AS rep_ordinal, coalesce(m.t, ticks) AS ticks, origin, CASE WHEN m.o IS NULL THEN derived_segment_ix ELSE m.seg END AS derived_segment_ix, CASE WHEN m.o IS NULL THEN last_edit ELSE 'replace' END AS last_edit
        FROM pm LEFT JOIN (SELECT * FROM mo WHERE code IS NULL) m ON m.source_id = pm.source_id AND m.page_id = pm.page_id""",
        *_REPLAY,
    ),
    "e06_replay_outcomes": fx.sql(
        f"""SELECT *, CAST(count(*) FILTER (status = 'changed') OVER (PARTITION BY source_id ORDER BY seq) AS INT) AS revision
        FROM ({_ADDED} UNION ALL SELECT * FROM dj UNION ALL SELECT * FROM mj UNION ALL SELECT * FROM rj)""",
        *_REPLAY,
    ),
}
