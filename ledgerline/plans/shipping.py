"""Executors get this package from the driver, wherever the driver has it from."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application; needed before functions of the package run in Python workers."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(top):
        path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "ledgerline.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in sorted(os.walk(top)):
                for f in sorted(names):
                    if f.endswith(".py"):
                        z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), os.path.dirname(top)))
        sc.addPyFile(path)
    _shipped.add(sc.applicationId)
