"""Exact deduplication by content sort, in DataFrame functions alone.

The normalised texts are range-partitioned by splitters that Spark samples from them, sorted externally inside each range,
and each row is compared in full with its neighbour: a window over the range's keys and the whole text needs no second
exchange, since the range partitioning already keeps equal keys together. The first row of a run of equals, by
identifier, stays.

Ranges follow the first ``HEAD`` characters of a text, so splitters stay short and no text reaches the driver. What would
fill a range is seen in a sample of rows: a beginning that many texts share is cut up by a hash of the whole text, and a text
that is itself so frequent by identifier, into ``salts`` slots. A frequent text then forms one run a slot; its runs, one row
each, are stitched together afterwards. The sample decides about balance only: results are the same without it.

Defined results: a null text counts as empty; null identifiers sort last and are kept only if a group has no
other; of repeated rows with the same identifier exactly one stays; an empty table gives an empty result;
columns of the input that bear an output name give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_RUN, cut_lineage, documents, free_name, partitions, without, written

#: Rows of the sample, on average, for each range.
SAMPLED = 200
#: A beginning or text with so many rows of the sample is frequent: an eighth of a range. At most 8 a range are.
FREQUENT = 25
SALTS = 64
#: Characters of a text that ranges follow.
HEAD = 32


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def frequent(docs: DataFrame, text_col: str, ranges: int, least: int = FREQUENT) -> DataFrame:
    """(often_head, often_hash) of the sample's frequent beginnings; the hash is null, or that of a frequent text.

    Fewer than 2 * SAMPLED * ranges / least rows, whatever the input.
    """
    share = min(1.0, SAMPLED * ranges / max(1, docs.count()))
    text = normalised(F.col(text_col))
    seen = cut_lineage(docs.select(text_col).sample(share, 17).select(F.substring(text, 1, HEAD).alias("often_head"), F.xxhash64(text).alias("often_hash")))
    heads = seen.groupBy("often_head").count().where(F.col("count") >= least).select("often_head", F.lit(None).cast("long").alias("often_hash"))
    texts = seen.groupBy("often_head", "often_hash").count().where(F.col("count") >= least).drop("count")
    return heads.unionByName(texts)


def runs(docs: DataFrame, *, id_col: str, text_col: str, least: int, salts: int) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` and, of each row's run of equal texts, the first identifier, the size, the row's place, the digest and whether the text is cut.

    Also the names of these columns.
    """
    own = {x: free_name(docs, f"run_{x}") for x in ("first", "size", "place", "digest", "cut")}
    norm, head, tail, slot = (free_name(docs, f"run_{x}") for x in ("norm", "head", "tail", "slot"))
    ranges = partitions(docs.sparkSession)
    often = frequent(docs, text_col, ranges, least)
    heads = often.where("often_hash IS NULL").select(F.col("often_head").alias("head_of"))
    texts = often.where("often_hash IS NOT NULL").select(F.col("often_hash").alias("hash_of")).distinct()
    marked = docs.withColumn(norm, normalised(F.col(text_col))).withColumn(head, F.substring(norm, 1, HEAD))
    marked = marked.join(F.broadcast(heads), F.col(head) == F.col("head_of"), "left")  # bounded by the sample's size
    # A text shorter than the head is its own beginning, so it needs no hash to be told from others.
    marked = marked.withColumn(tail, F.when(F.col("head_of").isNull(), F.lit(0)).otherwise(F.xxhash64(norm)))
    marked = marked.join(F.broadcast(texts), F.col(tail) == F.col("hash_of"), "left")  # bounded likewise
    marked = marked.withColumn(slot, F.when(F.col("hash_of").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts))))
    # The text is carried once: it is normalised again on the other side of the exchange.
    ranged = marked.drop(norm, "head_of", "hash_of").repartitionByRange(ranges, head, tail, slot).withColumn(norm, normalised(F.col(text_col)))
    equals = Window.partitionBy(head, tail, slot, norm)
    ordered = equals.orderBy(F.col(id_col).asc_nulls_last())
    told = ranged.withColumn(own["place"], F.row_number().over(ordered)).withColumn(own["first"], F.first(id_col).over(ordered))
    told = told.withColumn(own["size"], F.count(F.lit(1)).over(equals)).withColumn(own["digest"], F.unhex(F.sha2(norm, 256))).withColumn(own["cut"], F.col(slot) >= 0)
    return told.select(*(F.col(f"`{c}`") for c in docs.columns), *own.values()), own


def stitched(told: DataFrame, own: dict[str, str]) -> DataFrame:
    """``told`` with first and size of whole groups: of a text that was cut, its runs are summed up, from one row a run."""
    ends = told.where(F.col(own["cut"]) & (F.col(own["place"]) == 1))
    # At most ``salts`` rows for each of the sample's frequent texts.
    whole = ends.groupBy(F.col(own["digest"]).alias("whole_digest")).agg(F.min(own["first"]).alias("whole_first"), F.sum(own["size"]).alias("whole_size"))
    joined = told.join(F.broadcast(whole), F.col(own["cut"]) & (F.col(own["digest"]) == F.col("whole_digest")), "left")
    cut = F.col("whole_digest").isNotNull()
    first, size = (F.when(cut, F.col(f"whole_{x}")).otherwise(F.col(own[x])) for x in ("first", "size"))
    return joined.withColumns({own["first"]: first, own["size"]: size}).drop("whole_digest", "whole_first", "whole_size")


def winner(id_col: str, own: dict[str, str]) -> Column:
    """Whether a row is the one of its group that stays: first of its run, and its run holds the group's first identifier.

    Rows without an identifier lie in one slot, so one run of a cut text has them all.
    """
    return (F.col(own["place"]) == 1) & F.col(f"`{id_col}`").eqNullSafe(F.col(own["first"]))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = FREQUENT, salts: int = SALTS, prefix: str = "", text: bool = True) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256 (lowercase hex of the normalised text); without its text if not ``text``."""
    names = [prefix + n for n in ("keep_id", "group_size", "kept", "text_sha256")]
    docs = without(docs, names)
    told, own = runs(docs, id_col=id_col, text_col=text_col, least=least, salts=salts)
    columns = [c for c in docs.columns if text or c != text_col]
    told = stitched(written(told.select(*(F.col(f"`{c}`") for c in columns), *own.values())), own)
    return told.select(
        *(F.col(f"`{c}`") for c in columns), F.col(own["first"]).alias(names[0]), F.col(own["size"]).alias(names[1]),
        winner(id_col, own).alias(names[2]), F.lower(F.hex(own["digest"])).alias(names[3]),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir).select("doc_id", "text"), text=False)


OP10_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that stay, with the columns of ``docs``: of equal texts the smallest identifier's, one of repeated rows.

    An empty table stays empty; null texts count as empty ones, and one of them stays.
    """
    told, own = runs(docs, id_col="doc_id", text_col="text", least=FREQUENT, salts=SALTS)
    firsts = written(told.where(F.col(own["place"]) == 1))  # one row a run: what is written is what stays, but for texts cut into slots
    return stitched(firsts, own).where(winner("doc_id", own)).select(*(F.col(f"`{c}`") for c in docs.columns))
