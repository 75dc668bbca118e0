"""Bringing this package to the executors."""

from __future__ import annotations

import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once a context: operators that run there in Python need it.

    The archive is made on the driver and handed out by Spark. Where the package is installed on all machines, this
    isn't needed.
    """
    sc = spark.sparkContext
    if sc in _shipped:
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp()) / "cardloom.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(out))
    _shipped[sc] = str(out)
