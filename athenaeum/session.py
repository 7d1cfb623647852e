"""Sessions with the settings the library is tested with."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, Arrow. Partition counts and sizes are left to the cluster's own settings unless given."""
    builder = SparkSession.builder.appName("athenaeum")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if master and master.startswith("local"):
        settings |= {"spark.sql.shuffle.partitions": str(os.cpu_count() or 8), "spark.ui.enabled": "false"}
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each application: their Python needs it wherever it lies on the driver."""
    context = spark.sparkContext
    if getattr(context, "_athenaeum_shipped", False):
        return spark
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="athenaeum-")) / "athenaeum.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._athenaeum_shipped = True
    return spark
