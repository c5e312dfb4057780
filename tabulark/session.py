"""Sessions, and this package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def get_session(app: str = "tabulark", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; conf adds or overrides settings (dots as `__`)."""
    b = SparkSession.builder.appName(app)
    for k, v in {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"}.items():
        b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers of every executor, once per application.
    The archive is served by the driver; executors that join later fetch it too."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="tabulark-ship-"), "tabulark_package.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for root, dirs, files in os.walk(here):
                dirs[:] = [d for d in dirs if d != "__pycache__"]
                for f in files:
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark
