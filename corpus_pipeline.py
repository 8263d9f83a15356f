"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each one's result as Parquet in the shared folder and hands it to the next.
All but the last return the columns of documents.

In every stage, a null text counts as empty, rows may be repeated, additional
columns are handed on, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontamination, minhash, mixing, nbsvm, sharding
from loomgraph.llm.common import table, word_count, written

SHARDS = 16


def packed(docs: DataFrame) -> DataFrame:
    """Id, text, and one column `row` with all others, so that no name of theirs can clash with one that a stage makes."""
    rest = [F.col(f"`{c}`").alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest or [F.lit(None).cast("int").alias("none")]).alias("row"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("row").getField(c).alias(c) for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from the labels outside the held-out fifth.

    An empty text gets the score of a text without n-grams. Equal texts are
    judged alike. Labels of null ids and null labels teach nothing; without
    labels of both kinds the share of good ones judges all.
    """
    model = nbsvm.train(docs, nbsvm.learnable(table(spark, sf_dir, "labels")))
    return unpacked(nbsvm.scored(packed(docs), model).where(F.col("score") >= nbsvm.THRESHOLD), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    Empty texts are near nothing and all stay. Of a group, a row with the
    smallest id stays, one with a null id only if all have none; of repeated
    rows, one.
    """
    return unpacked(minhash.deduplicated(packed(docs)), docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item.

    Empty texts have none; null and empty items are in no text.
    """
    return unpacked(decontamination.with_hits(packed(docs), table(spark, sf_dir, "benchmark")).where(F.size("hits") == 0), docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, at most twice.

    A null source is a source of its own. Empty texts have no words; how often
    they are taken changes no target.
    """
    whole = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns])
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), whole.alias("row"))
    mix = mixing.mixed(rows, "size").where("copies > 0")
    return mix.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def sharding_keys(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the shard of their id; a null id has one as well. An input column `shard` is replaced."""
    return sharding.assign(docs, "doc_id", [1.0] * SHARDS)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-duplicates", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing", mixing_sources),
    ("sharding", sharding_keys),
]

#: SQL can express neither the classifier nor the searches; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k + 1}")
    return docs
