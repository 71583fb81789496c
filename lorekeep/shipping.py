"""Sends this package to the session's executors, which need not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the running application, once."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix=f"{here.name}-", suffix=".zip")
    with os.fdopen(fd, "wb") as out, zipfile.ZipFile(out, "w") as packed:
        for path in sorted(here.rglob("*.py")):
            packed.write(path, path.relative_to(here.parent))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)
