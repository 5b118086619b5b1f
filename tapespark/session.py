"""Sessions, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def local(cores: str = "*", partitions: int = 8, **more: str) -> SparkSession:
    """A session for one machine, in UTC, with adaptive execution and Arrow."""
    conf = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.sql.execution.arrow.pyspark.enabled": "true"} | more
    return SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()


def prepare(spark: SparkSession) -> None:
    """Times are read in UTC, and the executors have the package."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship(spark)


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each application, unless their path has it."""
    here = str(ROOT)
    context = spark.sparkContext
    if context.applicationId in _shipped or here in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(context.applicationId)
    path = Path(tempfile.mkdtemp()) / "tapespark.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((ROOT / "tapespark").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
        if (ROOT / "corpus_pipeline.py").exists():
            z.write(ROOT / "corpus_pipeline.py", "corpus_pipeline.py")
    context.addPyFile(str(path))
