"""Sends this package to the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the application, once, so that workers need no installation of it."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    here = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="opticframe-code-")) / "opticframe.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"{here.name}/{f.relative_to(here)}")
    spark.sparkContext.addPyFile(str(path))
    _SENT.add(app)
