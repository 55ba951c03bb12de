"""Making the package importable in the tasks of a session."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the workers, once a session, unless they find it by themselves: by PYTHONPATH or the working folder."""
    home = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    found = {str(Path(p).resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {os.getcwd()}
    if context.applicationId not in _SHIPPED and str(home) not in found:
        base = Path(tempfile.mkdtemp(prefix="spark-")) / "quarrylight"
        context.addPyFile(shutil.make_archive(str(base), "zip", home, "quarrylight"))
    _SHIPPED.add(context.applicationId)
    return spark
