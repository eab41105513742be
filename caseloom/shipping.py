"""Hands this package to Python workers, which need not have it on their path."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT = "_caseloom_sent"


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once for each application; Spark brings them to every worker."""
    context = spark.sparkContext
    if getattr(context, _SENT, False):
        return
    root, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    folder = tempfile.mkdtemp(prefix="code-")
    path = os.path.join(folder, f"{root.name}.zip")
    Path(path).write_bytes(packed.getvalue())
    context.addPyFile(path)
    setattr(context, _SENT, True)
