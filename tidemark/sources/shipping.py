"""Sends this package to the Python workers, so that it need not be installed on them."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_TOP = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    out = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark-package.zip")  # the driver serves it to the executors
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(_TOP, "tidemark")):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, _TOP))
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)
