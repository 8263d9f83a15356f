"""Connected components of an edge table, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import shared_dir


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Columns node, component: for each node of an edge, the smallest node that it can reach.

    Alternates two steps until nothing changes: every node hands its larger
    neighbours to its smallest one, then every node hands its smaller ones. The
    number of edges never grows, minima are combined before the shuffle, and
    the rounds grow with the logarithm of the longest path. Each round is
    checkpointed in the shared folder. Null ends and loops are dropped; loops
    of otherwise unknown nodes therefore give no row.
    """
    shared_dir(edges.sparkSession)
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    total = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).alias("t")
    was = e.agg(total).first()["t"]
    while was[0]:
        # Large step: with m the smallest of u and its neighbours, each larger neighbour of u points to m.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small step: with m the smallest neighbour of u below it, u and its other smaller neighbours point to m.
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        down = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = down.unionByName(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        now = e.agg(total).first()["t"]
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
