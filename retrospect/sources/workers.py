"""Giving Python workers this package where it is not installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add the package to the application's Python files, once, unless PYTHONPATH has it for the workers already."""
    root = Path(__file__).resolve().parents[2]
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if root in known or context.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "retrospect.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted((root / "retrospect").rglob("*.py")):
            out.write(source, source.relative_to(root))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
