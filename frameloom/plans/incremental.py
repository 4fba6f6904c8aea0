"""Runs that analyse again only what has changed since a published one, and keep the rest of its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lookups import drifted
from .publish import Store

#: What tells a source's content and the settings it was analysed with.
IDENTITY = ["size_bytes", "fingerprint", "settings_key"]


def changes_since(registered: DataFrame | None, sources: DataFrame, identity: list[str] = IDENTITY) -> DataFrame:
    """(source_id, change) of sources to be analysed: ``unregistered`` ones, and those of which a column differs, null-safely, by the columns' names."""
    if registered is None:
        return sources.select("source_id", F.lit("unregistered").alias("change"))
    joined = sources.select("source_id").join(registered.select("source_id"), "source_id", "left_anti").select("source_id", F.lit("unregistered").alias("change"))
    found = drifted(registered.select("source_id", *identity), sources.select("source_id", *identity), identity, "source_id")
    return found.where("change NOT IN ('missing', 'unregistered')").unionByName(joined)


def incremental_run(store: Store, run_id: str, sources: DataFrame, analyse: Callable[[DataFrame], dict[str, DataFrame]], previous: str | None = None, identity: list[str] = IDENTITY) -> str:
    """Publishes ``run_id`` from the rows of ``previous`` for unchanged sources and from ``analyse`` for all others. Returns the status.

    ``sources`` holds all sources of the new run, a row each: source_id and the columns of ``identity``. ``analyse`` is given those (source_id) to be
    analysed, and returns tables with a source_id; frames of no other source are asked for. Sources that are gone are left out. The run's table
    ``sources`` is what the next run compares with; ``lineage`` says for each source which run its rows come from, and why.
    """
    old = None if previous is None else store.read(previous, "sources")
    changed = changes_since(old, sources, identity)
    kept = sources.select("source_id").join(changed, "source_id", "left_anti")
    fresh = changed.select("source_id", F.lit(run_id).alias("from_run"), "change")
    tables = analyse(changed.select("source_id"))
    if previous is not None:
        tables = {name: store.read(previous, name).join(kept, "source_id", "left_semi").unionByName(new) for name, new in tables.items()}
        fresh = fresh.unionByName(store.read(previous, "lineage").join(kept, "source_id", "left_semi").select("source_id", "from_run", F.lit(None).cast("string").alias("change")))
    return store.publish(run_id, {**tables, "sources": sources.select("source_id", *identity), "lineage": fresh})
