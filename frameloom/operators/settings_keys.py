"""Settings as data: detector payloads, keys that do not depend on order, document versions, and what to analyse again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timeline_version(policy: Column, index_complete: Column, algorithm: Column) -> Column:
    """The version a new document has; version 5 is only ever read."""
    half, spatial = policy == "half", algorithm == "spatial"
    return F.when(half & (index_complete | spatial), 7).when(half | spatial, 6).otherwise(4)


def detector_struct(fields: dict[str, Column]) -> Column:
    """Settings as a struct whose fields are in the order of their names."""
    return F.struct(*(fields[name].alias(name) for name in sorted(fields)))


def settings_key(fields: dict[str, Column]) -> Column:
    """An identity of settings that does not depend on the order in which they are given; nulls are part of it."""
    return F.sha2(F.to_json(detector_struct(fields), {"ignoreNullFields": "false"}), 256)


def to_reanalyse(wanted: DataFrame, published: DataFrame) -> DataFrame:
    """Wanted (source_id, settings_key) rows without a published run of the same settings."""
    return wanted.join(published.select("source_id", "settings_key"), ["source_id", "settings_key"], "left_anti")
