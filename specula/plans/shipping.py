"""Gives the package to Python workers that couldn't import it otherwise."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import specula

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the context, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(specula.__file__).parent
    archive = os.path.join(tempfile.mkdtemp(prefix="specula-ship-"), "specula.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
