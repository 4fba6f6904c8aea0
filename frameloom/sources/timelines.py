"""Timeline documents: strict reading, assembly and the simple form."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The fields of documents of all versions and of both detectors, and their types.
_METRICS = "STRUCT<changed_fraction:DOUBLE,changed_cell_fraction:DOUBLE>"
_DIFFERENCES = "STRUCT<global_mad:DOUBLE,max_tile_mad:DOUBLE,changed_fraction:DOUBLE>"
_RECT = "STRUCT<x:BIGINT,y:BIGINT,width:BIGINT,height:BIGINT>"
DOCUMENT_SCHEMA = (
    "schema_version BIGINT,"
    "source STRUCT<basename:STRING,size_bytes:BIGINT,mtime_ns:BIGINT,chunk_sha256:STRING,stream_index:BIGINT,codec:STRING,coded_width:BIGINT,coded_height:BIGINT,sar_num:BIGINT,sar_den:BIGINT,"
    "rotation_cw:BIGINT,display_width:BIGINT,display_height:BIGINT,time_base_num:BIGINT,time_base_den:BIGINT,origin_pts:BIGINT,time_origin:STRING>,"
    "duration_s DOUBLE,duration_kind STRING,"
    "sampling STRUCT<algorithm:STRING,cache_max_width:BIGINT,jpeg_quality:BIGINT,selection_policy:STRING,keyframe_index_complete:BOOLEAN>,"
    f"roi {_RECT},ignore_masks ARRAY<{_RECT}>,"
    "detector STRUCT<algorithm:STRING,image_max_width:BIGINT,mask_dilation_px:BIGINT,input_policy:STRING,"
    "spatial:STRUCT<pixel_delta:BIGINT,changed_fraction:DOUBLE,cell_fraction:DOUBLE,cell_changed_fraction:DOUBLE,tile_size:BIGINT>,"
    "representative:STRUCT<support_samples:BIGINT,edge_delta:BIGINT,core_edge_fraction:DOUBLE,overlay_fraction:DOUBLE,overlay_missing_edges:BIGINT,transient_penalty:DOUBLE>,"
    "debounce_samples:BIGINT,global_mad:DOUBLE,tile_mad:DOUBLE,pixel_delta:BIGINT,changed_fraction:DOUBLE,tile_size:BIGINT,tile_stride:BIGINT,min_tile_valid_fraction:DOUBLE,keep_unconfirmed:BOOLEAN>,"
    "samples ARRAY<STRUCT<sample_id:STRING,ordinal:BIGINT,source_pts:BIGINT,timestamp_s:DOUBLE,cache_width:BIGINT,cache_height:BIGINT,is_analysis_observation:BOOLEAN>>,"
    f"detected_boundaries ARRAY<STRUCT<boundary_id:STRING,left_sample_id:STRING,right_sample_id:STRING,lower_s:DOUBLE,upper_s:DOUBLE,observed_at_s:DOUBLE,true_boundary_s:DOUBLE,uncertainty_kind:STRING,status:STRING,persistence_samples:BIGINT,spatial_metrics:{_METRICS},adjacent_metrics:{_DIFFERENCES},anchor_metrics:{_DIFFERENCES}>>,"
    "detected_segments ARRAY<STRUCT<segment_id:STRING,start_s:DOUBLE,end_s:DOUBLE,first_sample_id:STRING,last_sample_id:STRING,auto_representative_sample_id:STRING,start_boundary_id:STRING>>,"
    "pages ARRAY<STRUCT<page_id:STRING,pdf_page:BIGINT,representative_sample_id:STRING,representative_timestamp_s:DOUBLE,origin:STRING,origin_segment_id:STRING,derived_segment_id:STRING,last_edit:STRING>>,"
    "navigation_ranges ARRAY<STRUCT<page_id:STRING,start_s:DOUBLE,end_s:DOUBLE,basis:STRING,is_slide_boundary:BOOLEAN>>,"
    "artifact STRUCT<export_id:STRING,project_revision:BIGINT,created_at:STRING,generator_version:STRING,pdf_basename:STRING,pdf_page_count:BIGINT,pdf_sha256:STRING>"
)
NULLABLE = {"true_boundary_s", "start_boundary_id", "origin_segment_id", "derived_segment_id"}


#: Fields that only documents of one detector have.
_SPATIAL = {"detector.input_policy", "detector.spatial", "detector.representative", "detected_boundaries.spatial_metrics"}
_ANCHOR = {f"detector.{c}" for c in ("debounce_samples", "global_mad", "tile_mad", "pixel_delta", "changed_fraction", "tile_size", "tile_stride", "min_tile_valid_fraction", "keep_unconfirmed")}
_ANCHOR |= {"detected_boundaries.adjacent_metrics", "detected_boundaries.anchor_metrics"}
#: Fields that came with a version.
_SINCE = {6: {"sampling.selection_policy"}, 7: {"sampling.keyframe_index_complete", "samples.is_analysis_observation"}}
SPATIAL_ALGORITHM, ANCHOR_ALGORITHM = "spatial-groups-v1", "masked-anchor-tile-v1"
#: The detectors that documents of a version may have.
VERSIONS = {4: (ANCHOR_ALGORITHM,), 5: (SPATIAL_ALGORITHM,), 6: (SPATIAL_ALGORITHM, ANCHOR_ALGORITHM), 7: (SPATIAL_ALGORITHM, ANCHOR_ALGORITHM)}


def _shape(kind: T.DataType, without: set[str], path: str = ""):
    """A schema as nested plain values, for the check in tasks; fields whose path is in ``without`` are left out."""
    if isinstance(kind, T.StructType):
        return {f.name: _shape(f.dataType, without, f"{path}.{f.name}".lstrip(".")) for f in kind if f"{path}.{f.name}".lstrip(".") not in without}
    if isinstance(kind, T.ArrayType):
        return [_shape(kind.elementType, without, path)]
    return kind.typeName()


def document_shapes() -> dict[tuple[int, str], dict]:
    """The exact fields and types of documents, by version and detector."""
    schema = T.StructType.fromDDL(DOCUMENT_SCHEMA)
    later = lambda version: {field for since, fields in _SINCE.items() if since > version for field in fields}
    return {(v, a): _shape(schema, later(v) | (_ANCHOR if a == SPATIAL_ALGORITHM else _SPATIAL)) for v, algorithms in VERSIONS.items() for a in algorithms}


def _fault(value, shape, name: str) -> str | None:
    """The first place where a parsed value does not have its exact fields and types."""
    if isinstance(shape, dict):
        if not isinstance(value, dict) or set(value) != set(shape):
            return f"{name}: fields"
        return next((f for k in shape if (f := _fault(value[k], shape[k], k))), None)
    if isinstance(shape, list):
        if not isinstance(value, list):
            return f"{name}: array"
        return next((f for x in value if (f := _fault(x, shape[0], name))), None)
    if value is None:
        return None if name in NULLABLE else f"{name}: null"
    fits = {"string": (str,), "long": (int,), "double": (int, float), "boolean": (bool,)}[shape]
    return None if type(value) in fits else f"{name}: type"


def _document_fault(value, shapes: dict[tuple[int, str], dict]) -> str | None:
    """As _fault, by the version and detector that the document names; an unknown detector is told by its fields."""
    version = value.get("schema_version") if isinstance(value, dict) else None
    if type(version) is int and version not in VERSIONS:
        return "schema_version: unknown"
    version = version if type(version) is int else max(VERSIONS)
    detector = value.get("detector") if isinstance(value, dict) else None
    detector = detector if isinstance(detector, dict) else {}
    algorithm = detector.get("algorithm")
    if algorithm not in VERSIONS[version]:
        algorithm = SPATIAL_ALGORITHM if "spatial" in detector else ANCHOR_ALGORITHM
    return _fault(value, shapes[version, algorithm if algorithm in VERSIONS[version] else VERSIONS[version][0]], "document")


def strict_fault():
    """A function that says what keeps a text from being a document of its version and detector: null if nothing does."""
    shapes = document_shapes()

    def unique(pairs):
        found = dict(pairs)
        if len(found) < len(pairs):
            raise ValueError("duplicate field")
        return found

    def constant(name):
        raise ValueError("not a finite number")

    @F.pandas_udf(T.StringType())
    def check(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return "json: null"
            try:
                value = json.loads(text, object_pairs_hook=unique, parse_constant=constant)
            except (ValueError, RecursionError) as e:
                return f"json: {'duplicate field' if 'duplicate' in str(e) else 'not a finite number' if 'finite' in str(e) else 'malformed'}"
            return _document_fault(value, shapes)

        return texts.map(one)

    return check


def parse(documents: DataFrame, column: str = "document") -> tuple[DataFrame, DataFrame]:
    """(documents, rejects): rows whose text is a document, with it parsed as ``d``; the others with the ``fault``."""
    schema = T.StructType.fromDDL(DOCUMENT_SCHEMA)
    checked = documents.withColumn("fault", strict_fault()(F.col(column)))
    good = checked.where("fault IS NULL").drop("fault").withColumn("d", F.from_json(column, schema))
    return good, checked.where("fault IS NOT NULL")


def read_timelines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents, one a file, and rejects."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("document"))
    return parse(text)


def simple_documents(navigation: DataFrame) -> DataFrame:
    """(source_id, document): one ``{"slides": [{page, start, end}, ...]}`` a source."""
    rows = F.array_sort(F.collect_list(F.struct("page", F.col("start_s").alias("start"), F.col("end_s").alias("end"))))
    return navigation.groupBy("source_id").agg(rows.alias("slides")).select("source_id", F.to_json(F.struct("slides")).alias("document"))


def ordered(rows: DataFrame, order: str, name: str, **fields: Column) -> DataFrame:
    """Rows of a source as one array of structs, in order."""
    item = F.struct(F.col(order).alias("_o"), F.struct(*(c.alias(n) for n, c in fields.items())).alias("_v"))
    return rows.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_v"]).alias(name))
