"""Makes the package known to Python workers that cannot import it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, unless they find it on PYTHONPATH or, in local mode, in the working folder."""
    sc = spark.sparkContext
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(ROOT.parent) in known or sc.master.startswith("local") and "cluster" not in sc.master and os.getcwd() == str(ROOT.parent) or sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    # a file of the driver alone, from which Spark serves it
    with tempfile.NamedTemporaryFile(prefix="lorespark-", suffix=".zip", delete=False) as f, zipfile.ZipFile(f, "w") as z:
        for p in ROOT.rglob("*.py"):
            z.write(p, p.relative_to(ROOT.parent))
    sc.addPyFile(f.name)
