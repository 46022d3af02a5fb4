"""Brings this package to Python workers, which needn't have it installed or on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the application's Python files, once."""
    context = spark.sparkContext
    if getattr(context, "_stratagrid_shipped", False):
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="stratagrid-")) / "stratagrid_sources.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(here.rglob("*.py")):
            out.write(source, source.relative_to(here.parent))
    context.addPyFile(str(archive))
    context._stratagrid_shipped = True
