"""Gives the executors this package's code."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the Python path of the session's executors, once an application.

    Workers need it wherever the code isn't installed on every machine. The archive stays on the driver until it ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        package, top = Path(__file__).resolve().parents[1], tempfile.mkdtemp(prefix="gristmill-ship-")
        atexit.register(shutil.rmtree, top, ignore_errors=True)
        shutil.copytree(package, Path(top, "tree", package.name), ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
        spark.sparkContext.addPyFile(shutil.make_archive(str(Path(top, "gristmill_code")), "zip", Path(top, "tree")))
    return spark
