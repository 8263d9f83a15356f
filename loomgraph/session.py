"""Session factory used by tests, the bench and small local runs."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def send_package(spark: SparkSession) -> None:
    """Sends the package along once, so that Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "loomgraph_sent", False):
        return
    package = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="loomgraph-")) / "loomgraph.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(path))
    sc.loomgraph_sent = True


def local_session(cores: int | str = 8, name: str = "loomgraph", **conf: str) -> SparkSession:
    """A local session with the settings that the library expects everywhere.

    On a cluster, pass your own session instead: nothing below is required
    but the UTC time zone.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LOOMGRAPH_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
