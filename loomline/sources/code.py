"""The package's own code on the executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package (without its training-data part) to the executors, once an application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    _sent.add(context.applicationId)
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        return  # workers of a local session import what the driver does
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py") and os.path.basename(folder) != "llm":
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    with tempfile.NamedTemporaryFile(suffix="-loomline.zip", delete=False) as out:  # read by the driver alone
        out.write(buffer.getvalue())
    context.addPyFile(out.name)
