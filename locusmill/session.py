"""Session helpers: a local session for tests, and shipping this package to the Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def local_session(cores: int | str = 8, partitions: int = 8, app: str = "locusmill") -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_locusmill_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="locusmill-src-")
    path = os.path.join(folder, "locusmill.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    sc.addPyFile(path)
    sc._locusmill_shipped = True
