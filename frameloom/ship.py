"""Bringing the package to executors that do not have it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to all executors of the session, where the repository is not on their path."""
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="frameloom-")) / "frameloom.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, Path(root.name) / path.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
