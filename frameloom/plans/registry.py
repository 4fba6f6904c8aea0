"""All registered queries of the frame timeline, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import detector_queries, document_queries, edit_queries, frame_queries, geometry_queries, job_queries, packet_queries, stream_queries

MODULES = (frame_queries, detector_queries, packet_queries, job_queries, geometry_queries, edit_queries, stream_queries, document_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.SQL.items()}
