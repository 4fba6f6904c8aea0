"""All-or-nothing publication of a run's tables.

Each attempt writes its tables to a folder of its own. A manifest with their places, counts and digests, written beside and
renamed last, makes them visible, all at once. Readers go by the latest manifest of a run, so an attempt that broke off is
not there, and overwriting a run leaves the old one whole until the new one is.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST = "run_id string, name string, n_rows long, digest string, status string, path string, attempt long"


class RunExists(ValueError):
    pass


def measures(columns: list[str]) -> list[Column]:
    """Sums that do not depend on the rows' order or partitions: their number and two row hashes."""
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(columns))), {"ignoreNullFields": "false"})
    return [F.count(F.lit(1)).alias("n"), *(F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)")).cast("string").alias(f"h{seed}") for seed in (1, 2))]


def digest(df: DataFrame) -> tuple[int, str]:
    """How many rows, and a digest of them."""
    n, a, b = df.select(*measures(df.columns)).first()
    return n, f"{a}:{b}"


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self, run_id: str | None = None) -> DataFrame:
        """The manifest rows of published runs (or of one, whose manifests alone are read): of each run those of its last attempt."""
        at, store = self._files(f"manifest/{'*' if run_id is None else run_id}/attempt-*")
        names = [x.getPath().toString() for x in store.globStatus(at) or ()]
        if not names:
            return self.spark.createDataFrame([], MANIFEST)
        rows = self.spark.read.schema(MANIFEST).json(names)
        last = rows.groupBy("run_id").agg(F.max("attempt").alias("attempt"))
        return rows.join(last, ["run_id", "attempt"]).select(rows.columns)

    def is_published(self, run_id: str) -> bool:
        return bool(self.runs(run_id).limit(1).count())

    def sweep(self, run_id: str) -> list[str]:
        """Removes what attempts left that no manifest of the run names, and gives their folders. Not while another writer is at it."""
        known = {r["path"].rsplit("/", 1)[0].rsplit("/", 1)[1] for r in self._manifests(run_id).select("path").distinct().collect()}  # a few paths a run
        at, store = self._files(f"run_id={run_id}/*")
        broken = [x.getPath() for x in store.globStatus(at) or () if x.getPath().getName() not in known]
        return [p.toString() for p in broken if store.delete(p, True)]

    def _manifests(self, run_id: str) -> DataFrame:
        """The manifest rows of all attempts of a run."""
        at, store = self._files(f"manifest/{run_id}/attempt-*")
        names = [x.getPath().toString() for x in store.globStatus(at) or ()]
        return self.spark.read.schema(MANIFEST).json(names) if names else self.spark.createDataFrame([], MANIFEST)

    def publish(self, run_id: str, tables: dict[str, DataFrame], overwrite: bool = False, guards: dict[str, DataFrame] | None = None) -> str:
        """Writes all tables, then the manifest. Guards are DataFrames that must be empty. Returns the status.

        Digests of the rows on their way to the files and of what the files hold are compared; where they differ, the run is
        published nevertheless, and says ``published_unverified``.
        """
        if self.is_published(run_id) and not overwrite:
            raise RunExists(run_id)
        broken = [name for name, rows in (guards or {}).items() if rows.limit(1).count()]
        if broken:
            raise ValueError(f"guards not met: {', '.join(broken)}")
        lines, same = [], True
        last = self.runs(run_id).agg(F.max("attempt")).first()[0]
        attempt, folder = (last or 0) + 1, f"{self.root}/run_id={run_id}/{uuid.uuid4().hex}"
        for name, df in tables.items():
            path, seen = f"{folder}/{name}", Observation()
            df.observe(seen, *measures(df.columns)).write.parquet(path)  # what was to be written is summed up on its way
            n, told = digest(self.spark.read.parquet(path))
            same = same and (n, told) == (seen.get["n"], f"{seen.get['h1']}:{seen.get['h2']}")
            lines.append({"run_id": run_id, "name": name, "n_rows": n, "digest": told, "path": path, "attempt": attempt})
        status = "published" if same else "published_unverified"
        draft, at = (self._files(x)[0] for x in (f"draft/{uuid.uuid4().hex}", f"manifest/{run_id}/attempt-{attempt:06d}"))
        self.spark.createDataFrame([(json.dumps(x | {"status": status}),) for x in lines], "value string").coalesce(1).write.text(draft.toString())
        _, store = self._files("manifest")
        store.mkdirs(at.getParent())
        if store.exists(at) or not store.rename(draft, at):
            raise RunExists(f"{run_id}: another writer has published attempt {attempt}")
        return status

    def read(self, run_id: str, name: str) -> DataFrame:
        """A table of a published run; a run without a manifest has none."""
        found = self.runs(run_id).where(F.col("name") == name).select("path").first()
        if found is None:
            raise ValueError(f"run {run_id} has no published table {name}")
        return self.spark.read.parquet(found["path"])


def page_frames(pages: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, failures): the full frame of every page (source_id, page, pts, roi) by its exact time, cut to the region."""
    from ..operators import lookups, tiles

    found, failed = lookups.exact_frames(pages, frames)
    cut = tiles.crop(found)
    return cut.where("reject_code IS NULL").drop("reject_code"), failed.select("source_id", "page", "pts").unionByName(cut.where("reject_code IS NOT NULL").select("source_id", "page", "pts"))
