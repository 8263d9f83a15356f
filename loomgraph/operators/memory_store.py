"""Writing memories: inserts, updates, deletes, merges and dedup, as whole-table rewrites."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import fingerprint


def bumped(memories: DataFrame, ids: DataFrame, as_of: str | None = None) -> DataFrame:
    """Access counts of the ids are one higher, and their last_accessed_at, where there is one, is `as_of`; the others stay."""
    hit = ids.select("id").distinct().withColumn("hit_", F.lit(1))
    rows = memories.join(hit, "id", "left").withColumn("access_count", F.col("access_count") + F.coalesce("hit_", F.lit(0)))
    if as_of and "last_accessed_at" in memories.columns:
        rows = rows.withColumn("last_accessed_at", F.when(F.col("hit_") == 1, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("last_accessed_at")))
    return rows.drop("hit_")


def updated(memories: DataFrame, chosen: Column, values: Mapping[str, Column], as_of: str) -> DataFrame:
    """Sets the given columns of the chosen rows, and their updated_at; without values nothing changes.

    New content brings its fingerprint along, where the memories have one.
    """
    if not values:
        return memories
    if "content" in values and "content_fingerprint" in memories.columns:
        values = {**values, "content_fingerprint": fingerprint(values["content"])}
    out = {name: F.when(chosen, value).otherwise(F.col(name)) for name, value in values.items()}
    return memories.withColumns(out | {"updated_at": F.when(chosen, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("updated_at"))})


def deleted(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """The memories without those ids."""
    return memories.join(ids.select("id"), "id", "left_anti")


def inserted_new(memories: DataFrame, new: DataFrame) -> DataFrame:
    """The memories with those of `new` whose id isn't there yet."""
    return memories.unionByName(new.join(memories.select("id"), "id", "left_anti"))


def merged(old: DataFrame, new: DataFrame, key: Sequence[str], keep_old: Sequence[str] = ()) -> DataFrame:
    """Upsert by key: new rows win, but the columns `keep_old` of a row that was there stay."""
    both = old.withColumn("is_new_", F.lit(0)).unionByName(new.withColumn("is_new_", F.lit(1)))
    last = both.groupBy(*key).agg(F.max_by(F.struct(*[c for c in old.columns if c not in key]), "is_new_").alias("last_"), F.min_by(F.struct(*keep_old or [key[0]]), "is_new_").alias("first_"))
    return last.select(*[F.col(c) if c in key else F.col(f"first_.{c}").alias(c) if c in keep_old else F.col(f"last_.{c}").alias(c) for c in old.columns])


def first_of_each(memories: DataFrame, text: str = "content", order: str = "id") -> DataFrame:
    """One row per fingerprint: fingerprint, keep_id (the smallest), copies."""
    return memories.select(fingerprint(F.col(text)).alias("fingerprint"), order).groupBy("fingerprint").agg(F.min(order).alias("keep_id"), F.count(F.lit(1)).alias("copies"))


def ingested(store: DataFrame, batch: DataFrame, text: str, order: Sequence[str]) -> DataFrame:
    """Rows of the batch that are stored: the first of each fingerprint, unless the store has it already."""
    keyed = batch.select(fingerprint(F.col(text)).alias("fp_"), F.struct(*order).alias("order_"), F.struct(*batch.columns).alias("row_"))
    first = keyed.groupBy("fp_").agg(F.min_by("row_", "order_").alias("row_")).select("fp_", "row_.*")
    return first.join(store.select(fingerprint(F.col("content")).alias("fp_")).distinct(), "fp_", "left_anti").drop("fp_")


def counted(memories: DataFrame, *by: str) -> DataFrame:
    """Number of memories, expired ones included, by parts of the scope."""
    return memories.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
