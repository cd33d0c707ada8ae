"""Makes the package importable on executors, wherever the driver found it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package's files to the executors of a session, once; Spark's file server hands them out."""
    sc = spark.sparkContext
    if getattr(sc, "_asofline_shipped", False) or not PACKAGE.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="asofline-")) / "asofline-package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    sc.addPyFile(str(path))
    sc._asofline_shipped = True
