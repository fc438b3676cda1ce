"""Spark sessions for tests and benchmarks, and the package on the workers' path."""

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session with the settings that the tests and bench.py use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers import this package wherever they start: its sources go to them once per application."""
    context = spark.sparkContext
    if getattr(context, "_foliagrid_shipped", False):
        return
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, True)  # the driver serves the file to workers as long as it lives
    path = os.path.join(folder, "foliagrid.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(_PACKAGE.rglob("*.py")):
            archive.write(source, source.relative_to(_PACKAGE.parent))
    context.addPyFile(path)
    context._foliagrid_shipped = True
