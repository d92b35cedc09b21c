"""Making this package importable in Python workers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    base = Path(tempfile.mkdtemp(prefix="tideline-package-")) / here.name
    archive = shutil.make_archive(str(base), "zip", here.parent, here.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
