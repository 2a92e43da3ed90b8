"""Sends this package's code to the executors' Python."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once per application, so that executors need no path of their own to the package."""
    sc = spark.sparkContext
    if getattr(sc, "_quillspan_shipped", False):
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quillspan-code-")
    atexit.register(shutil.rmtree, folder, True)
    file = Path(folder) / "quillspan_code.zip"
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(file))  # executors fetch it from the driver
    sc._quillspan_shipped = True
