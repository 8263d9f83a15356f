"""Watching file changes: debounced bursts, keyed state from a stream of changes, and changes routed to projects."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators.graph import prefix_matched
from loomgraph.sources.change_log import COMPACT_AT, ChangeLog


def bursts(changes: DataFrame, gap_ms: int = 500, path: str = "path", ts: str = "ts") -> DataFrame:
    """Batch form of the debounce: path, first_ts, last_ts, n of each run of changes without a gap of gap_ms."""
    order = Window.partitionBy(path).orderBy(ts)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = changes.select(path, ts, micros.alias("us_")).withColumn("new_", (F.coalesce(F.col("us_") - F.lag("us_").over(order), F.lit(gap_ms * 1000)) >= gap_ms * 1000).cast("int"))
    rows = rows.withColumn("run_", F.sum("new_").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(path, "run_").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n")).drop("run_")


def stream_bursts(changes: DataFrame, gap_ms: int = 500, late: str = "10 seconds", path: str = "path", ts: str = "ts") -> DataFrame:
    """Streaming form: a session window per path, with a watermark that bounds the state."""
    rows = changes.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    window = F.session_window(ts, f"{gap_ms} milliseconds")
    return rows.groupBy(path, window.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(path, F.col("w.start").alias("first_ts"), "n")


def latest_states(changes: DataFrame, path: str = "path", ts: str = "ts", kind: str = "kind") -> DataFrame:
    """The last change of each path: path, kind, ts; of equal times the largest kind."""
    return changes.groupBy(path).agg(F.max(F.struct(ts, kind)).alias("last")).select(path, F.col(f"last.{kind}").alias(kind), F.col(f"last.{ts}").alias(ts))


def follow(changes: DataFrame, folder: str, checkpoint: str, path: str = "path", ts: str = "ts", kind: str = "kind") -> StreamingQuery:
    """Keeps the last change of each path in a log: a micro-batch writes the last changes of its own paths only.

    A batch that is run again after a failure replaces itself, and a restart
    goes on where the checkpoint says, with new data or without. The log is
    compacted every COMPACT_AT batches. The state is read with state_of().
    """
    log = ChangeLog(changes.sparkSession, folder, path)
    if log.epoch() < 0 and log.rows("states") is None:
        empty = changes.sparkSession.createDataFrame([], changes.select(path, kind, ts).schema)
        log.compact({"states": empty, "touched": empty.select(path)})  # the state before the first batch

    def merge(batch: DataFrame, epoch: int) -> None:
        rows = latest_states(batch.select(path, ts, kind), path, ts, kind).persist()
        log.append(epoch, {"states": rows}, rows)
        rows.unpersist()
        if log.batches() >= COMPACT_AT:
            log.compact({"states": latest_states(log.rows("states"), path, ts, kind), "touched": rows.select(path).limit(0)})

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state_of(spark: SparkSession, query: StreamingQuery | None, folder: str, path: str = "path", ts: str = "ts", kind: str = "kind") -> DataFrame:
    """The state after the last micro-batch that was written; empty before the first. The query isn't asked, as one that found nothing new has no progress."""
    rows = ChangeLog(spark, folder, path).rows("states")
    if rows is None:
        raise ValueError(f"nothing was followed into {folder}")
    return latest_states(rows, path, ts, kind)


def route(changes: DataFrame, projects: DataFrame, folder: str, checkpoint: str, path: str = "path") -> StreamingQuery:
    """Writes each change with the project whose root is the longest prefix of its path, null if none is: Parquet by batch and project.

    Projects (project, root) are read anew for each micro-batch. A batch that is
    run again after a failure replaces its own folder.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.persist()
        found = prefix_matched(rows.select(F.col(path).alias("path")), projects).withColumnRenamed("path", path)
        out = rows.drop("project").join(found, path, "left")
        out.write.mode("overwrite").partitionBy("project").parquet(f"{folder.rstrip('/')}/batch={epoch}")
        rows.unpersist()

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def routed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All routed changes: the columns of the schema, and project. Empty before the first batch; one project's are read from its own folders only."""
    whole = f"{schema}, batch long, project string"
    try:
        rows = spark.read.schema(whole).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], whole)
    return rows.drop("batch")
