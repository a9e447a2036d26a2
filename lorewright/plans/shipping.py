"""Giving the executors this package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import lorewright


def ship(spark: SparkSession) -> None:
    """Send the package's code to the executors, once a Spark context, so that their Python workers can import it wherever
    they run. Spark's own file server carries it."""
    context = spark.sparkContext
    if getattr(context, "_lorewright_shipped", False):
        return
    root = Path(lorewright.__file__).parent
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="lorewright-code-")), "lorewright-code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(archive)
    context._lorewright_shipped = True
