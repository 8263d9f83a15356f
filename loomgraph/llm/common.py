"""Helpers that several operators share: tables, the shared folder, words."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The ASCII white space between words, as characters.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the folder; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as named by spark.checkpoint.dir.

    Where the setting is unset, a temporary folder of this machine is set for a
    local session, as in tests; on a cluster that is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='loomgraph-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def written(df: DataFrame, tag: str) -> DataFrame:
    """The frame, written as Parquet in the shared folder and read again.

    This cuts the lineage: a lost executor costs no recomputation, as the
    files outlive it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/loomgraph/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unit_hash(*parts: Column) -> Column:
    """A number in (0, 1) that the parts alone decide: 52 bits of an MD5."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def word_count(text: Column) -> Column:
    """Number of words of the text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def send_package(spark: SparkSession) -> None:
    """Sends the package along once, so that Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "loomgraph_sent", False):
        return
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="loomgraph-")) / "loomgraph.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(path))
    sc.loomgraph_sent = True


@contextmanager
def python_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Jobs that start inside hand rows to Python workers in batches of at most so many, which bounds a worker's memory.

    The caller's setting holds again afterwards. Frames that are only planned
    inside, and run later, come in batches of the caller's setting, which Spark
    bounds by 64 MB as well.
    """
    send_package(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)

