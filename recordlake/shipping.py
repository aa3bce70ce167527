"""Sends this package to executors, whose interpreters may not have it installed."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp()  # the context serves the archive from here as long as it lives
    os.makedirs(f"{folder}/tree")
    shutil.copytree(os.path.join(root, "recordlake"), f"{folder}/tree/recordlake", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/recordlake", "zip", f"{folder}/tree"))
    _shipped.add(app)
