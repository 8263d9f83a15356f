"""Weighted rendezvous hashing of stable record keys.

Every shard draws a number for a key from a hash of both; the draw is scaled
by the shard's weight and the smallest wins. A shard's draws do not depend on
the other shards, so one more shard takes records only into itself, and a
removed shard's records are the only ones that move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import table, unit_hash

#: Hexadecimal digits of the bucket in which slots are counted: 4096 buckets a shard.
BUCKET_DIGITS = 3
#: Copies of one row that are given out by one inner array.
RUN = 65536


def draw(key: Column, shard: int, weight: float) -> Column:
    """The shard's draw for the key: exponential with the weight as its rate."""
    return -F.log(unit_hash(key, F.lit(shard))) / F.lit(float(weight))


def assign(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard") -> DataFrame:
    """Adds the shard (0 to len(weights) - 1) of each row's key.

    A projection: nothing is shuffled. A null key is a key like any other; rows
    of equal keys share a shard. A shard of weight 0 takes nothing; all weights
    0, or a negative one, raise ValueError. An input column called like the
    output is replaced.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be above 0")
    draws = [F.struct(draw(F.col(f"`{key}`"), i, w).alias("d"), F.lit(i).alias("i")) for i, w in enumerate(weights) if w > 0]
    best = F.array_min(F.array(*draws))["i"] if len(draws) > 1 else draws[0]["i"]
    return df.withColumn(out, best.cast("int"))


def numbered(df: DataFrame, shard: str, columns: Sequence[str]) -> DataFrame:
    """Rows of these columns with a gapless slot (from 0) in each shard.

    Equal rows are counted before they are shuffled, and the counts are dealt
    by shard and a bucket of a hash of the whole row; so neither a large shard
    nor a row with many copies meets in one task. Slots follow the order of
    bucket and columns; which of several equal rows gets which of their slots
    makes no difference.
    """
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]))
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows_")).withColumn("bucket_", F.substring(digest, 1, BUCKET_DIGITS))
    sizes = counted.groupBy(shard, "bucket_").agg(F.sum("n_rows_").alias("in_bucket_"))
    before = Window.partitionBy(shard).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(shard).alias("s_"), F.col("bucket_").alias("b_"), F.coalesce(F.sum("in_bucket_").over(before), F.lit(0)).alias("start_"))
    inside = Window.partitionBy(shard, "bucket_").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("before_", F.coalesce(F.sum("n_rows_").over(inside), F.lit(0)))
    placed = placed.join(starts, (F.col(shard) == F.col("s_")) & (F.col("bucket_") == F.col("b_")))
    runs = placed.withColumn("run_", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_rows_") - 1) / RUN).cast("long"))))
    last = F.least(F.col("n_rows_"), (F.col("run_") + 1) * RUN) - 1
    rows = runs.withColumn("copy_", F.explode(F.sequence(F.col("run_") * RUN, last)))
    return rows.select(*columns, (F.col("start_") + F.col("before_") + F.col("copy_")).cast("long").alias("slot"))


def op1_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 of equal weight, under the law `key`.

    A null text has size 1 and the checksum of the empty text; a null doc_id is
    a key of its own. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = assign(assign(docs, "doc_id", [1.0] * 16), "doc_id", [1.0] * 17, out="grown_shard")
    rows = numbered(rows, "shard", ["shard", "doc_id", "size", "text_crc32", "grown_shard"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _draw_sql(i: int) -> str:
    return f"struct_pack(d := -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{i}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0), i := {i})"


ORACLE = f"""
WITH RECURSIVE steps(i, c, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), c AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(list_transform(range(0, size - 1), lambda j: ('0x' || substr(h, (2 * j + 1)::BIGINT, 2))::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT)) AS text_crc32
  FROM d, crc_table
), s AS (
  SELECT *, list_min([{", ".join(_draw_sql(i) for i in range(16))}]).i AS shard,
    list_min([{", ".join(_draw_sql(i) for i in range(17))}]).i AS grown_shard FROM c
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(concat_ws('|', shard, coalesce(doc_id::VARCHAR, 'null'), size, text_crc32, grown_shard)), 1, {BUCKET_DIGITS}), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
  grown_shard::INTEGER AS grown_shard
FROM s
"""
