"""Sessions, and shipping this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the Python workers, once for each application: they inherit PYTHONPATH, not the driver's sys.path."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="quire-ship-"), "quire.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark


def checkpointed(spark: SparkSession) -> SparkSession:
    """Have a folder for checkpoint(): the shared one of spark.checkpoint.dir. Where none is set, one of our own, if all executors are in this process."""
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not jsc.isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="quire-"))
    return spark


def local_session(cores: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    b = SparkSession.builder.master(f"local[{cores}]").config("spark.ui.enabled", "false").config("spark.driver.memory", memory)
    b = b.config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "8").config("spark.ui.showConsoleProgress", "false")
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
