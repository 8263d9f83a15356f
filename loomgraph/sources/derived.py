"""Tables and indexes that are derived from files once, and again only when these have changed."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or a temporary one where it is unset, as in tests; checkpoints go there too."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    found = found.rstrip("/") if found else f"file://{tempfile.mkdtemp(prefix='loomgraph-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def written(df: DataFrame, kind: str) -> DataFrame:
    """The frame, written as Parquet in the shared folder and read again, so that several uses compute it once."""
    folder = f"{shared_folder(df.sparkSession)}/loomgraph/{kind}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def state_of(*tables: DataFrame) -> str:
    """A digest of the paths, sizes and times of the files that tables are read from; no column is read."""
    parts = []
    for df in tables:
        m = df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"), F.col("_metadata.file_modification_time").alias("t")).distinct()
        row = m.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("p", "s", "t").cast("decimal(20,0)")).alias("h")).first()
        parts.append(f"{row['n']}:{row['h']}")
    return hashlib.md5("|".join(parts).encode()).hexdigest()


def kept(spark: SparkSession, kind: str, sources: list[DataFrame], build: Callable[[str], None]) -> str:
    """The folder in which `build` put something made of these tables; it is built if their files are new.

    A mark is written after all else, so what a failed build has left is built
    anew, in another folder.
    """
    marks = f"{shared_folder(spark)}/loomgraph/kept/{kind}-{state_of(*sources)}"
    schema = "folder string"
    try:
        row = spark.read.schema(schema).parquet(marks).orderBy("folder").first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        row = None
    if row:
        return row["folder"]
    folder = f"{shared_folder(spark)}/loomgraph/{kind}-{uuid.uuid4().hex}"
    build(folder)
    spark.createDataFrame([(folder,)], schema).coalesce(1).write.mode("append").parquet(marks)
    return folder
