"""A store of memories that is written to: storing, recalling, updating and deleting are commits.

A commit writes the rows of its own ids only. Recalling adds one row per
recalled id, and counts are added up when the store is read. Several writers
may work at once; see CommittedLog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import memory_store, memory_tools
from loomgraph.sources.change_log import COMPACT_AT
from loomgraph.sources.commits import CommittedLog

#: Columns that an update may set.
SETTABLE = ("content", "summary", "tags", "importance", "embedding")


class MemoryLog:
    """The store in a folder. Memories have at least id, content, embedding, access_count, created_at and expires_at."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.log = spark, CommittedLog(spark, folder, "id")

    def create(self, memories: DataFrame) -> None:
        """Writes the first version, whose columns all later ones have; an error if the store is there already."""
        if self.log.epoch() >= 0:
            raise ValueError(f"there is a store in {self.log.folder}")
        tables = {"rows": memories, "bumps": self._bumps(memories.limit(0), "1970-01-01")}
        self.log.commit(lambda: (tables, memories.limit(0)), "base")

    @staticmethod
    def _bumps(ids: DataFrame, as_of: str) -> DataFrame:
        return ids.select("id", F.lit(as_of).cast("timestamp_ntz").alias("at_"))

    def current(self) -> DataFrame:
        """All memories as of the last commit; access counts hold the recalls since a memory's row was written."""
        entries = self.log._entries()
        rows = self.log.current("rows", entries, with_epoch=True)
        since = self.log.rows("bumps", entries).withColumnRenamed("epoch_", "bump_").join(rows.select("id", "epoch_"), "id").where("bump_ > epoch_")
        counted = since.groupBy("id").agg(F.count(F.lit(1)).alias("n_"), F.max("at_").alias("at_"))
        out = rows.join(counted, "id", "left").withColumn("access_count", (F.col("access_count") + F.coalesce("n_", F.lit(0))).cast(rows.schema["access_count"].dataType))
        if "last_accessed_at" in rows.columns:
            out = out.withColumn("last_accessed_at", F.greatest("last_accessed_at", "at_"))
        return out.select(*[c for c in rows.columns if c != "epoch_"])

    def _commit(self, change) -> str:
        """Commits the (rows, ids touched) that a function makes of the current memories; the folder that holds them."""

        def made():
            rows, touched = change(self.current())
            return {"rows": rows, "bumps": self._bumps(rows.limit(0), "1970-01-01")}, touched

        _, at = self.log.commit(made)
        if self.log.batches() >= COMPACT_AT:
            self.compact()
        return at

    def compact(self) -> None:
        """Writes the current memories as the version that readers start from."""

        def made():
            rows = self.current()
            return {"rows": rows, "bumps": self._bumps(rows.limit(0), "1970-01-01")}, rows.limit(0)

        self.log.commit(made, "base")

    def store(self, new: DataFrame, as_of: str) -> DataFrame:
        """Stores memories (content, embedding, other columns of the store); tells of each: id, stored, contradictions, long_note.

        Without an id column each gets a UUID, if the store's ids are strings.
        Null ids, and ids that are there already, aren't stored; of several
        rows of a new id, one is. Contradictions are looked for among the
        memories from before the call. Columns that aren't given are null, but
        the access count is 0 and the times are `as_of`.
        """
        before = self.current()
        types = {f.name: f.dataType for f in before.schema}
        given = "id" in new.columns
        if not given and types["id"].simpleString() != "string":
            raise ValueError("memories without ids need a store whose ids are strings")
        start = {"id": F.uuid(), "access_count": F.lit(0), "created_at": F.lit(as_of), "updated_at": F.lit(as_of)}
        rows = new.select(*[(F.col(c) if c in new.columns else start.get(c, F.lit(None))).cast(t).alias(c) for c, t in types.items()])

        def change(now: DataFrame) -> tuple[DataFrame, DataFrame]:
            fresh = rows.where("id is not null").dropDuplicates(["id"]).join(now.select("id"), "id", "left_anti").select(*types) if given else rows
            return fresh, rows.limit(0)  # no id is there before, so nothing is superseded; ids that are made must not be made twice

        at = self._commit(change)
        written = self.spark.read.schema(before.schema).parquet(f"{at}/rows")  # ids are made once; what follows reads them
        told = memory_tools.stored(before, written, as_of).select("id", F.lit(True).alias("stored"), "contradictions", "long_note")
        if not given:
            return told
        refused = rows.select("id").distinct().join(written.select("id"), "id", "left_anti")
        nothing = [F.lit(None).cast(told.schema[c].dataType).alias(c) for c in ("contradictions", "long_note")]
        return told.unionByName(refused.select("id", F.lit(False).alias("stored"), *nothing))

    def recall(self, query_vector: DataFrame, text: str, as_of: str, **choices) -> DataFrame:
        """What memory_tools.recall finds, and counts one access of each; the counts told are those from before."""
        found = memory_tools.recall(self.current(), query_vector, text, as_of, **choices)
        rows = found.collect()  # 25 at most
        told = self.spark.createDataFrame(rows, found.schema)
        if rows:
            self.log.commit(lambda: ({"rows": self.current().limit(0), "bumps": self._bumps(told, as_of)}, told.limit(0)))
            if self.log.batches() >= COMPACT_AT:
                self.compact()
        return told

    def update(self, changes: DataFrame, as_of: str) -> DataFrame:
        """Sets what isn't null of content, summary, tags, importance and embedding by id; tells of each id: updated, reason.

        New content brings its fingerprint along, where the store has one. Of
        several changes of an id, the greatest row counts.
        """
        given = [c for c in SETTABLE if c in changes.columns]
        if not given:
            raise ValueError("nothing to set")
        one = changes.where("id is not null").groupBy("id").agg(F.max(F.struct(*given)).alias("set_"))

        def change(now: DataFrame) -> tuple[DataFrame, DataFrame]:
            values = {c: F.coalesce(F.col(f"set_.{c}").cast(now.schema[c].dataType), F.col(c)) for c in given}
            rows = memory_store.updated(now.join(one, "id"), F.lit(True), values, as_of).select(*now.columns)
            return rows, rows

        at = self._commit(change)
        return self._told(one, f"{at}/touched", "updated")

    def delete(self, ids: DataFrame) -> DataFrame:
        """Deletes memories; tells of each id: deleted, reason."""
        asked = ids.where("id is not null").select("id").distinct()
        at = self._commit(lambda now: (now.limit(0), now.select("id").join(asked, "id")))
        return self._told(asked, f"{at}/touched", "deleted")

    def _told(self, asked: DataFrame, touched: str, done: str) -> DataFrame:
        """Whether each id asked for is among those touched."""
        hit = self.spark.read.schema(asked.select("id").schema).parquet(touched).withColumn("hit_", F.lit(True))
        return asked.select("id").join(hit, "id", "left").select("id", F.coalesce("hit_", F.lit(False)).alias(done), F.when(F.col("hit_").isNull(), "not found").alias("reason"))
