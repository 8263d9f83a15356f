"""Mixing sources to target weights.

Words are counted per source; targets follow the sources' weights, up to a
number of repetitions; each document is then taken floor(rate) times, and once
more if a hash of its id falls below the fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import table, unit_hash, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
#: Sources up to which their table is broadcast; beyond it the join is left to Spark.
BROADCAST_SOURCES = 50_000


def targets(sizes: DataFrame, source: str, size: str, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Target of each source: columns source, source_size, target.

    The sources, by code point and null last, weigh as in `weights`, repeated.
    They share `share` times all sizes; none gets over `most` times its own, and
    what is above is shared among the others by weight until none is above.
    That end state is found at once: sorted by limit per weight, the sources up
    to some place get their limits and the others the same amount per weight.
    Only the aggregated sources, never documents, meet in the sorted windows.
    A source of size 0 gets 0.
    """
    per = sizes.groupBy(source).agg(F.sum(size).cast("long").alias("source_size"))
    order = Window.orderBy(F.col(source).asc_nulls_last())
    per = per.withColumn("w_", F.array(*[F.lit(float(w)) for w in weights])[((F.row_number().over(order) - 1) % len(weights)).cast("int")])
    per = per.withColumn("limit_", F.col("source_size") * F.lit(float(most)))
    tight = Window.orderBy(F.col("limit_") / F.col("w_"), F.col(source).asc_nulls_last())
    upto, every = tight.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("left_", F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("limit_").over(upto), F.lit(0.0)))
    per = per.withColumn("weight_", F.sum("w_").over(every) - F.coalesce(F.sum("w_").over(upto), F.lit(0.0)))
    per = per.withColumn("level_", F.col("left_") / F.col("weight_"))
    level = F.min(F.when(F.col("level_") * F.col("w_") <= F.col("limit_"), F.struct(F.col("limit_") / F.col("w_"), F.col("level_").alias("v")))).over(every)["v"]
    per = per.withColumn("target", F.least(F.col("limit_"), F.coalesce(level, F.lit(float("inf"))) * F.col("w_")))
    return per.select(source, "source_size", "target")


def mixed(df: DataFrame, size: str, source: str = "source", key: str = "doc_id", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """Adds source_size, target and copies (how often the mix takes the row).

    A null source is a source of its own. Equal keys of one source decide
    alike; a source without words is taken 0 times. Input columns called like
    the outputs are replaced.
    """
    df = df.drop("source_size", "target", "copies")
    goals = targets(df.select(source, size), source, size, weights, share, most).withColumnRenamed(source, "source_of_goal_")
    if goals.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        goals = F.broadcast(goals)
    df = df.join(goals, F.col(source).eqNullSafe(F.col("source_of_goal_"))).drop("source_of_goal_")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    once_more = unit_hash(F.col(key), F.lit(seed)) < rate - F.floor(rate)
    return df.withColumn("copies", (F.floor(rate) + once_more.cast("long")).cast("long"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: sources weigh 5, 2, 1 and share 150 % of all words, twice their own at most.

    A null or empty text has size 0 and takes nothing. An empty table gives an
    empty result.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mixed(docs, "size").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, list_extract([5.0, 2.0, 1.0], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1)::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER t, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER t, 0)) AS level
  FROM w WINDOW t AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
g AS (SELECT source, source_size, least(cap, (SELECT level FROM l WHERE level * w <= cap ORDER BY cap / w, level LIMIT 1) * w) AS target FROM l),
r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix-1'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
