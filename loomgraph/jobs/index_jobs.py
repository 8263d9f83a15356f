"""Registered queries that index source files from end to end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.jobs.graph_jobs import _ORD, _checkpoints, shared_folder, source_files
from loomgraph.operators import indexing
from loomgraph.sources.tables import table

#: The moment of the first scan: files hold the orders before it.
FIRST_SCAN = "2001-01-01 00:00:00"


def _parsed(spark: SparkSession, files: DataFrame) -> indexing.Index:
    _checkpoints(spark)
    return indexing.parsed(files)


def scanned(spark: SparkSession, sf_dir: str, before: str | None = None) -> DataFrame:
    """The customers' source files; a file's time is that of its last order. In the later scan, customers in debt are gone."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit(before).cast("timestamp_ntz") if before else F.lit(True))
    times = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("mtime"))
    here = table(spark, sf_dir, "customer").where(F.lit(True) if before else F.col("c_acctbal") >= 0).select("c_custkey")
    rows = source_files(spark, sf_dir, before).join(here, "c_custkey").join(times, "c_custkey", "left")
    return rows.select("file_path", F.coalesce("mtime", F.lit("1970-01-01").cast("timestamp_ntz")).alias("mtime"), "content")


def _written(spark: SparkSession, index: indexing.Index) -> indexing.Index:
    folder = f"{shared_folder(spark)}/loomgraph/index-{uuid.uuid4().hex}"
    index.write(folder)
    return indexing.Index.read(spark, folder)


def _by_file(index: indexing.Index) -> DataFrame:
    return indexing.edges_of_files(index).groupBy("file_path", "rel_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 6).alias("confidence"))


def idx_full_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a whole index by file and type."""
    index = _parsed(spark, source_files(spark, sf_dir).select("file_path", F.lit(None).cast("timestamp_ntz").alias("mtime"), "content"))
    return _by_file(index)


def _second(spark: SparkSession, sf_dir: str) -> tuple[indexing.Index, DataFrame]:
    old = _parsed(spark, scanned(spark, sf_dir, FIRST_SCAN))
    index, states = indexing.reindexed(old, scanned(spark, sf_dir))
    return _written(spark, index), states


def idx_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by file and type after a second scan, in which files are new, changed, the same or gone."""
    index, _ = _second(spark, sf_dir)
    return _by_file(index)


def idx_reindex_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, states = _second(spark, sf_dir)
    return indexing.stats(index, indexing.edges(index), states)


QUERIES = {f.__name__: f for f in (idx_full_index, idx_reindex, idx_reindex_stats)}

_EDGES = "SELECT file_path, 'defines' AS rel_type, m + 2 AS n, (m + 2)::DOUBLE AS confidence FROM g UNION ALL SELECT file_path, 'calls', m - 1, (m - 1)::DOUBLE FROM g WHERE m > 1"
_TIMES = f"t AS (SELECT c_custkey, c_acctbal >= 0 AS there, max(o_orderdate) AS now_, max(o_orderdate) FILTER (o_orderdate < TIMESTAMP '{FIRST_SCAN}') AS then_ FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)"
ORACLES = {
    "idx_full_index": f"WITH {_ORD}, g AS (SELECT * FROM f) {_EDGES}",
    "idx_reindex": f"WITH {_ORD}, g AS (SELECT f.* FROM f JOIN customer USING (c_custkey) WHERE c_acctbal >= 0) {_EDGES}",
    "idx_reindex_stats": f"""WITH {_ORD}, {_TIMES}, g AS (SELECT f.m, t.* FROM f JOIN t USING (c_custkey))
  SELECT count(*) FILTER (there) AS scanned, count(*) FILTER (there AND now_ IS DISTINCT FROM then_) AS changed, count(*) FILTER (NOT there) AS deleted,
  coalesce(sum(m + 3) FILTER (there), 0)::BIGINT AS symbols, coalesce(sum(m + 2 + greatest(m - 1, 0)) FILTER (there), 0)::BIGINT AS relationships FROM g""",
}
