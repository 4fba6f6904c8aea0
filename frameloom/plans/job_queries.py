"""Registered queries over jobs, outputs, timings, stores, fingerprints and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import checks, jobs, lookups
from ..sources.fingerprint import fingerprint
from . import packet_queries

NOW = 1_004_918_400  # 2001-11-05
DAY, HOUR = 86_400 * 365, 3_600 * 365


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as inputs; every tenth one comes again in capitals, every tenth with é taken apart, and one is a target itself."""
    pages = fx.table(spark, sf_dir, "pages").select(F.col("page_id").alias("job_ix"), F.regexp_replace("url", r"[?#].*$", "").alias("input"))
    loud = pages.where("job_ix % 10 = 0").select((F.col("job_ix") + 1_000_000_000).alias("job_ix"), F.upper("input").alias("input"))
    accents = pages.where("job_ix % 10 = 3").select((F.col("job_ix") + 2_000_000_000).alias("job_ix"), F.concat(F.lit("in/"), F.when(F.col("job_ix") % 20 == 3, F.lit("café")).otherwise(F.lit("café")), F.lit(".mp4")).alias("input"))
    own = pages.where("job_ix % 50 = 7").select((F.col("job_ix") + 3_000_000_000).alias("job_ix"), F.concat(F.lit("OUT/"), F.lit("x.slides.pdf")).alias("input"))
    fixed = pages.where("job_ix % 50 = 8").select((F.col("job_ix") + 4_000_000_000).alias("job_ix"), F.lit("in/x.mp4").alias("input"))
    return jobs.plan_outputs(pages.union(loud).union(accents).union(own).union(fixed), "out")


def p16_plan_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outputs(spark, sf_dir)


def j10_output_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.output_collisions(_outputs(spark, sf_dir))


def u02_nfc_casefold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.names import nfc_casefold

    rows = _outputs(spark, sf_dir).where("kind = 'pdf'")
    return rows.select("job_ix", nfc_casefold("input").alias("key"))


def a14_source_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import frame_queries

    frames = fx.frames(spark, sf_dir)
    pages = frame_queries.analysis(spark, sf_dir).pages.select("source_id", "rep_ordinal")
    got = jobs.source_results(lookups.sample_times(pages, fx.timed_samples(frames, fx.frame_sources(frames))))
    return got.select("source_id", "page_count", F.array_join(F.transform("representative_pts", lambda x: x.cast("string")), ",").alias("representative_pts"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "error").otherwise("cancelled")
    return fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("job_ix"), status.alias("status"))


def a15_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.batch_summary(_jobs(spark, sf_dir))


def a16_phase_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of events as hundredths of seconds, so that sums are exact."""
    phase = F.when(F.col("event_type") == "view", "detection").when(F.col("event_type") == "click", "cache_prepare").when(F.col("event_type") == "signup", "sampling").when(F.col("event_type") == "error", "roi").otherwise("assembly")
    rows = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), phase.alias("phase"), F.round(F.col("value") * 100).cast("long").alias("seconds"))
    return jobs.phase_times(rows, ("detection", "cache_prepare", "sampling", "roi", "assembly"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session"), (F.col("l_quantity") * 1000).cast("long").alias("bytes"), (F.col("l_linenumber") % 3 != 0).alias("is_image"), (F.col("l_linestatus") == "F").alias("complete"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("updated_at"), (F.col("l_returnflag") == "R").alias("pinned"))


def a17_store_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders reserve room for their lines; every seventh order also for a session that has no file yet."""
    orders = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session"), F.floor("o_totalprice").cast("long").alias("ceiling"))
    reserved = orders.where("session % 4 <> 0").union(orders.where("session % 7 = 0").select(-F.col("session") - 1, "ceiling"))
    return jobs.store_usage(_files(spark, sf_dir), reserved)


def a18_expired_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    sessions = files.groupBy("session").agg(F.bool_and("complete").alias("complete"), F.max("updated_at").alias("updated_at"))
    pins = files.groupBy("session").agg(F.count_if("pinned").alias("n")).where("n >= 2")
    return jobs.expired_sessions(sessions, pins, F.lit(NOW), DAY, HOUR).select("session", "complete", "updated_at", "age")


def s05_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select("doc_id", fingerprint(F.encode("text", "UTF-8"), 1024).alias("fingerprint"))


def j09_source_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second listing of the documents: every 7th has other contents, every 11th is gone, every 13th is only newer."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    base = docs.select(F.col("doc_id").cast("string").alias("path"), F.octet_length("content").cast("long").alias("size_bytes"), F.lit(1).cast("long").alias("mtime_ns"), F.sha2("content", 256).alias("fingerprint"), "doc_id")
    n = F.col("doc_id")
    again = base.where("doc_id % 11 <> 0").select("path", (F.col("size_bytes") + (n % 7 == 0).cast("long")).alias("size_bytes"), (F.col("mtime_ns") + (n % 13 == 0).cast("long")).alias("mtime_ns"), F.when(n % 7 == 0, F.sha2(F.col("fingerprint").cast("binary"), 256)).otherwise(F.col("fingerprint")).alias("fingerprint"))
    return lookups.drifted(base.drop("doc_id"), again, ["size_bytes", "mtime_ns", "fingerprint"])


def j12_snapshot_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose settings changed against a snapshot, null-safely: every 6th has another size, every 10th lost its brand."""
    part = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_brand", "p_type", F.col("p_size").cast("long").alias("p_size"))
    key = F.col("path").cast("int")
    now = part.select("path", F.when(key % 10 != 0, F.col("p_brand")).alias("p_brand"), "p_type", (F.col("p_size") + (key % 6 == 0).cast("long")).alias("p_size"))
    return lookups.drifted(part, now, ["p_brand", "p_type", "p_size"])


def a13_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that a supplier is asked for more than once."""
    return checks.duplicates(fx.table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


def w06_metadata_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of a conversation: ``system`` is unknown; a change against the last known role is drift."""
    rows = fx.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("source_id"), "turn", "role")
    got = checks.drift(rows, "role", "turn", F.col("role") == "system", F.lit(False), stretch=4)
    return got.select("source_id", "turn", "role", "last_known", "code")


def w03_role_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments on data without pixels: a boundary wherever the role changes."""
    from pyspark.sql.window import Window

    from ..operators import segments

    rows = fx.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("source_id"), F.col("turn").alias("ordinal"), "role")
    flags = rows.withColumn("is_boundary", F.coalesce(F.col("role") != F.lag("role").over(Window.partitionBy("source_id").orderBy("ordinal")), F.lit(False)))
    return segments.segment_numbers(rows, flags).select("source_id", "ordinal", "is_boundary", "segment_ix")


def j07_missing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items, shifted by a tenth of the parts, whose part is not known."""
    rows = fx.table(spark, sf_dir, "lineitem").select(F.lit("all").alias("source_id"), F.when(F.col("l_partkey") % 17 != 0, F.col("l_partkey") * 11 / 10).cast("long").alias("part"), F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"))
    known = fx.table(spark, sf_dir, "part").select(F.lit("all").alias("source_id"), "p_partkey")
    return checks.missing_references(rows, "part", known, "p_partkey").drop("source_id")


def j08_observed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of sources that are observed (P11), by a semi join."""
    observed = packet_queries.p11_observations(spark, sf_dir).where("is_observation")
    return checks.present_references(packet_queries.samples(spark, sf_dir), "ordinal", observed, "ordinal").select("source_id", "ordinal", "ticks")


QUERIES = {
    f.__name__: f
    for f in (p16_plan_outputs, j10_output_collisions, u02_nfc_casefold, a14_source_result, a15_batch_summary, a16_phase_times, a17_store_usage, a18_expired_sessions, s05_fingerprint, j09_source_drift, j12_snapshot_change, a13_duplicate_keys, w06_metadata_drift, w03_role_segments, j07_missing_references, j08_observed_rows)
}

_P = """
pg AS MATERIALIZED (SELECT page_id AS job_ix, regexp_replace(url, '[?#].*$', '', 's') AS input FROM pages),
jb AS MATERIALIZED (SELECT * FROM pg UNION ALL SELECT job_ix + 1000000000, upper(input) FROM pg WHERE job_ix % 10 = 0
  UNION ALL SELECT job_ix + 2000000000, 'in/' || CASE WHEN job_ix % 20 = 3 THEN 'caf' || chr(233) ELSE 'cafe' || chr(769) END || '.mp4' FROM pg WHERE job_ix % 10 = 3
  UNION ALL SELECT job_ix + 3000000000, 'OUT/x.slides.pdf' FROM pg WHERE job_ix % 50 = 7 UNION ALL SELECT job_ix + 4000000000, 'in/x.mp4' FROM pg WHERE job_ix % 50 = 8),
nm AS MATERIALIZED (SELECT *, regexp_extract(input, '([^/]*)/*$', 1) AS name FROM jb),
ou AS MATERIALIZED (SELECT job_ix, input, kind, 'out/' || regexp_replace(name, '^(.+)\\.[^.]*$', '\\1') || '.slides.' || kind AS target FROM nm, (VALUES ('pdf'), ('json')) k(kind)),
fo AS MATERIALIZED (SELECT *, lower(nfc_normalize(target)) AS key, lower(nfc_normalize(input)) AS ikey FROM ou)
"""
SQL = {
    "p16_plan_outputs": fx.sql("SELECT * FROM ou", _P),
    "j10_output_collisions": fx.sql(
        """SELECT job_ix, kind, target, 'SharedTarget' AS reason FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM fo) WHERE n > 1
        UNION ALL SELECT job_ix, kind, target, 'TargetIsInput' FROM fo WHERE key IN (SELECT ikey FROM fo)""",
        _P,
    ),
    "u02_nfc_casefold": fx.sql("SELECT job_ix, ikey AS key FROM fo WHERE kind = 'pdf'", _P),
    "a14_source_result": fx.sql("SELECT source_id, count(*) AS page_count, string_agg(CAST(pts AS VARCHAR), ',' ORDER BY pts) AS representative_pts FROM g JOIN s ON g.source_id = s.source_id AND g.rep_ordinal = s.ordinal GROUP BY source_id".replace("SELECT source_id,", "SELECT g.source_id,").replace("GROUP BY source_id", "GROUP BY g.source_id"), fx.FRAMES_SQL, fx.SEGMENTS_SQL, fx.REPRESENTATIVES_SQL),
    "a15_batch_summary": """
WITH j AS (SELECT o_custkey AS batch, o_orderkey AS job_ix, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'error' ELSE 'cancelled' END AS status FROM orders),
o AS (SELECT *, CASE WHEN coalesce(max(CASE WHEN status = 'cancelled' THEN 1 ELSE 0 END) OVER (PARTITION BY batch ORDER BY job_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'skipped' ELSE status END AS outcome FROM j)
SELECT batch, count(*) FILTER (outcome = 'success') AS succeeded, count(*) FILTER (outcome = 'error') AS failed, count(*) FILTER (outcome = 'skipped') AS skipped,
CASE WHEN bool_or(outcome = 'cancelled') THEN 'cancelled' WHEN bool_or(outcome = 'error') THEN 'error' ELSE 'success' END AS status,
CASE WHEN bool_or(outcome = 'cancelled') THEN 130 WHEN bool_or(outcome = 'error') THEN 1 ELSE 0 END AS exit_code, string_agg(outcome, ',' ORDER BY job_ix) AS outcomes FROM o GROUP BY batch
""",
    "a16_phase_times": """
SELECT *, greatest(detection - cache_prepare, 0) AS detector_exclusive FROM (SELECT user_id AS run, """
    + ", ".join(f"CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type = '{e}'), 0) AS BIGINT) AS {p}" for e, p in (("view", "detection"), ("click", "cache_prepare"), ("signup", "sampling"), ("error", "roi"), ("purchase", "assembly")))
    + " FROM events GROUP BY user_id)",
    "a17_store_usage": """
WITH f AS (SELECT l_orderkey AS session, CAST(sum(CAST(l_quantity * 1000 AS BIGINT)) AS BIGINT) AS total_bytes, CAST(coalesce(sum(CAST(l_quantity * 1000 AS BIGINT)) FILTER (l_linenumber % 3 <> 0), 0) AS BIGINT) AS image_bytes FROM lineitem GROUP BY 1)
SELECT session, total_bytes, image_bytes, greatest(0, coalesce(CAST(floor(o_totalprice) AS BIGINT), 0) - image_bytes) AS outstanding FROM f LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 4 <> 0) o ON o.o_orderkey = f.session
UNION ALL SELECT -o_orderkey - 1, 0, 0, CAST(floor(o_totalprice) AS BIGINT) FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT o_orderkey, 0, 0, CAST(floor(o_totalprice) AS BIGINT) FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
""",
    "a18_expired_sessions": f"""
SELECT session, complete, updated_at, {NOW} - updated_at AS age FROM (SELECT l_orderkey AS session, bool_and(l_linestatus = 'F') AS complete, CAST(max(epoch(l_shipdate)) AS BIGINT) AS updated_at, count(*) FILTER (l_returnflag = 'R') AS pins FROM lineitem GROUP BY 1)
WHERE pins < 2 AND {NOW} - updated_at >= CASE WHEN complete THEN {DAY} ELSE {HOUR} END
""",
    "j09_source_drift": """
WITH b AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS path FROM documents)
SELECT path, CASE WHEN doc_id % 11 = 0 THEN 'missing' ELSE concat_ws(',', CASE WHEN doc_id % 7 = 0 THEN 'size_bytes' END, CASE WHEN doc_id % 13 = 0 THEN 'mtime_ns' END, CASE WHEN doc_id % 7 = 0 THEN 'fingerprint' END) END AS change
FROM b WHERE doc_id % 11 = 0 OR doc_id % 7 = 0 OR doc_id % 13 = 0
""",
    "j12_snapshot_change": """
SELECT CAST(p_partkey AS VARCHAR) AS path, concat_ws(',', CASE WHEN p_partkey % 10 = 0 THEN 'p_brand' END, CASE WHEN p_partkey % 6 = 0 THEN 'p_size' END) AS change FROM part WHERE p_partkey % 10 = 0 OR p_partkey % 6 = 0
""",
    "a13_duplicate_keys": "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "w06_metadata_drift": """
SELECT source_id, turn, role, last_known, 'MetadataDrift' AS code FROM (SELECT CAST(conv_id AS VARCHAR) AS source_id, turn, role,
last_value(CASE WHEN role <> 'system' THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_known FROM conversations) WHERE role <> 'system' AND last_known <> role
""",
    "w03_role_segments": """
SELECT source_id, ordinal, is_boundary, CAST(sum(CASE WHEN is_boundary THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY ordinal) AS INT) AS segment_ix FROM (
SELECT CAST(conv_id AS VARCHAR) AS source_id, turn AS ordinal, coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn), false) AS is_boundary FROM conversations)
""",
    "j07_missing_references": """
SELECT part, l_orderkey AS order_key, l_linenumber AS line FROM (SELECT *, l_partkey * 11 // 10 AS part FROM lineitem WHERE l_partkey % 17 <> 0) WHERE part NOT IN (SELECT p_partkey FROM part)
""",
    "j08_observed_rows": fx.sql("SELECT source_id, ordinal, ticks FROM ky JOIN po USING (source_id) WHERE policy = 'all' OR ordinal % 2 = 0", packet_queries._E),
    "s05_fingerprint": """
WITH b AS (SELECT doc_id, encode(text) AS c, octet_length(encode(text)) AS n FROM documents),
l AS (SELECT *, least(n, 1024) AS k, (n - least(n, 1024)) // 2 AS m, n - least(n, 1024) AS e FROM b)
SELECT doc_id, CASE WHEN n > 0 THEN sha256(encode('size:' || n || chr(10)) || encode('0:' || k || chr(10)) || c[1:k]
|| CASE WHEN m > 0 AND m <> e THEN encode(m || ':' || k || chr(10)) || c[m + 1:m + k] ELSE encode('') END || CASE WHEN e > 0 THEN encode(e || ':' || k || chr(10)) || c[e + 1:e + k] ELSE encode('') END) END AS fingerprint FROM l
""",
}
