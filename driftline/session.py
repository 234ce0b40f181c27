"""Session helpers shared by every part of the package."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application.

    Python workers import the package by name; on a cluster they do not share
    the driver's sys.path, so the sources travel as a zip with the job. Where the
    rows of an Arrow batch are left at Spark's default, they are lowered: rows
    here are whole texts, and a worker holds a batch several times over.
    """
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "2000")
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="driftline-ship-")
        atexit.register(shutil.rmtree, folder, True)
        target = Path(folder) / "driftline_pkg.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(Path(root.name) / p.relative_to(root)))
        spark.sparkContext.addPyFile(str(target))
        _SHIPPED.add(app)
    return spark
