"""Python workers import this package by name: it goes to them with the application."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_own_roots: dict[str, str] = {}


def ship(spark: SparkSession | None = None) -> None:
    """Sends this package to the executors, once per application; without an active session nothing happens."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="veilmark-")) / "veilmark_pkg.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, os.path.join(package.name, p.relative_to(package)))
    spark.sparkContext.addPyFile(str(out))
    _shipped.add(spark.sparkContext.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """A folder of this application in the shared one that the cluster names in spark.checkpoint.dir.

    Where that is unset, a local temporary folder serves a local master, whose driver and executors are one
    process; on a cluster every executor would write its own, so there it is an error.
    """
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _own_roots:
            _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="veilmark-")
        root = _own_roots[app]
    return f"{root.rstrip('/')}/veilmark/{app}"
