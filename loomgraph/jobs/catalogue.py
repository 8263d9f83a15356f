"""Every registered query of the library, with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.jobs import graph_jobs, index_jobs, log_jobs, memory_jobs, search_jobs, tool_jobs

FLAGSHIP = "mem_hybrid_recall"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return memory_jobs.QUERIES | graph_jobs.QUERIES | index_jobs.QUERIES | tool_jobs.QUERIES | search_jobs.QUERIES | log_jobs.QUERIES


def oracle_sql() -> dict[str, str]:
    return memory_jobs.ORACLES | graph_jobs.ORACLES | index_jobs.ORACLES | tool_jobs.ORACLES | search_jobs.ORACLES | log_jobs.ORACLES
