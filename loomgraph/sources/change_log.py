"""A log of changes to tables that share a key, merged when it is read.

A batch writes the new rows of the keys that it touches, and these keys; no
other key's rows are written again. A key's rows are those of the newest batch
that touches it. Compaction writes the merged tables as a base, after which
older batches aren't read; vacuum() deletes them. Each batch has a number, and
a batch that is run again replaces itself. A manifest, written last, says what
counts, so a batch that fails half-way changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Batches since the last base from which a log is compacted.
COMPACT_AT = 16
MANIFEST = "place long, epoch long, kind string, folder string"


class ChangeLog:
    """The log in a folder; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "file_path"):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key

    def _manifest(self) -> list[Row]:
        """The rows of the manifest, one a batch or base."""
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest").collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []

    def _entries(self) -> list[tuple[int, str, str]]:
        """(epoch, kind, folder) of the last base and the batches after it, in order."""
        rows = self._manifest()
        base = max((r["epoch"] for r in rows if r["kind"] == "base"), default=None)
        last = {(r["epoch"], r["kind"]): r for r in sorted(rows, key=lambda r: r["place"])}
        kept = [r for (e, kind), r in last.items() if (kind == "base" and e == base) or (kind == "batch" and (base is None or e > base))]
        return sorted((r["epoch"], r["kind"], r["folder"]) for r in kept)

    def epoch(self) -> int:
        """The number of the last batch; -1 if there is none."""
        return max((e for e, _, _ in self._entries()), default=-1)

    def batches(self) -> int:
        """Batches that a reader merges with the base."""
        return sum(kind == "batch" for _, kind, _ in self._entries())

    def _commit(self, epoch: int, kind: str, folder: str) -> None:
        place = self.spark.sql("SELECT unix_micros(current_timestamp())").first()[0]
        self.spark.createDataFrame([(place, epoch, kind, folder)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def append(self, epoch: int, tables: dict[str, DataFrame], touched: DataFrame) -> None:
        """Adds batch `epoch`: the rows of its keys, by table, and all keys that it touches (those without rows are gone)."""
        at = f"{self.folder}/batch-{epoch}"
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{at}/{name}")
        touched.select(self.key).distinct().write.mode("overwrite").parquet(f"{at}/touched")
        self._commit(epoch, "batch", at)

    def rows(self, name: str, entries: list[tuple[int, str, str]] | None = None) -> DataFrame | None:
        """All rows of a table that the base and the batches hold, with `epoch_`; None if there is nothing."""
        parts = [self.spark.read.parquet(f"{at}/{name}").withColumn("epoch_", F.lit(e)) for e, _, at in (self._entries() if entries is None else entries)]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def current(self, name: str, entries: list[tuple[int, str, str]] | None = None, with_epoch: bool = False) -> DataFrame | None:
        """The table as of the last batch, or of the entries given; None if there is nothing."""
        entries = self._entries() if entries is None else entries
        rows = self.rows(name, entries)
        later = [e for e in entries if e[1] == "batch"]
        if rows is None:
            return None
        columns = [c for c in rows.columns if with_epoch or c != "epoch_"]
        if not later:
            return rows.select(*columns)
        newest = self.rows("touched", later).groupBy(self.key).agg(F.max("epoch_").alias("newest_"))
        return rows.join(newest, self.key, "left").where("newest_ is null or newest_ <= epoch_").select(*columns)

    def compact(self, tables: dict[str, DataFrame]) -> None:
        """Writes these merged tables as the base of the last batch; later readers start from it."""
        epoch = self.epoch()
        at = f"{self.folder}/base-{epoch}"
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{at}/{name}")
        self._commit(epoch, "base", at)

    def vacuum(self) -> None:
        """Deletes the batches and bases that the last base stands for. Readers that began before it may fail."""
        used = {at for _, _, at in self._entries()}
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            if name.startswith(("batch-", "base-")) and f"{self.folder}/{name}" not in used:
                fs.delete(status.getPath(), True)

