"""Bring the package to the Python workers of a cluster."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: send the package, zipped, with Spark's own file distribution.

    The zip is made where the driver runs; Spark copies it to each worker.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    name = os.path.basename(_PACKAGE)
    folder = tempfile.mkdtemp(prefix=f"{name}-")
    made = shutil.make_archive(os.path.join(folder, name), "zip", os.path.dirname(_PACKAGE), name)
    spark.sparkContext.addPyFile(made)
    _shipped.add(application)
