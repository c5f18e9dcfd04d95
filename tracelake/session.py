"""Sessions, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(name: str = "tracelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` keys use __ for dots."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Sends this package to the executors, once per application, for functions that run in Python there."""
    spark = spark or SparkSession.active()
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="tracelake-"), "tracelake.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"tracelake/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
