"""Incremental indexing: what changed between two snapshots of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(stored: DataFrame, found: DataFrame, key: str = "file_path") -> DataFrame:
    """State of each file: new, changed, same or deleted, by its modification time to the microsecond."""
    s, d = stored.select(key, F.col("mtime").alias("stored_mtime")), found.select(key, F.col("mtime").alias("found_mtime"))
    both = s.join(d, key, "full_outer")
    state = (
        F.when(F.col("found_mtime").isNull(), "deleted")
        .when(F.col("stored_mtime").isNull(), "new")
        .when(~F.col("stored_mtime").eqNullSafe(F.col("found_mtime")), "changed")
        .otherwise("same")
    )
    return both.select(key, state.alias("state"))


def newer(files: DataFrame, since: str) -> DataFrame:
    """Files that were modified after the moment."""
    return files.where(F.col("mtime") > F.lit(since).cast("timestamp_ntz"))
