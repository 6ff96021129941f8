"""The package itself as a file that Spark hands to its executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession | None) -> None:
    """Once a context: executors may have no copy of this package, and share no folder with the driver."""
    if spark is None or getattr(spark.sparkContext, "_velamen_shipped", False):
        return
    here = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="velamen-")) / "velamen.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"velamen/{f.relative_to(here)}")
    spark.sparkContext.addPyFile(str(path))
    spark.sparkContext._velamen_shipped = True
