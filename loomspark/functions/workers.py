"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Once for each Spark context, sends the package's source to the executors through the driver's file server."""
    sc = spark.sparkContext
    if getattr(sc, "_loomspark_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="loomspark-")) / "loomspark_source.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(archive.resolve()))
    sc._loomspark_shipped = True
