"""Give the executors' Python workers this package."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

import marketframe

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once per application.

    Functions that run in workers are pickled by reference. Where the package is not
    installed on the cluster, workers would fail to import it.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="spark-"))
    package = Path(marketframe.__file__).parent
    archive = shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
