"""Sends the package to the executors, so that Python workers can import it wherever the driver runs from."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the context, once."""
    context = spark.sparkContext
    if getattr(context, "_lexweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lexweave-")) / "lexweave.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as package:
        for path in sorted(root.rglob("*.py")):
            package.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    context._lexweave_shipped = True
