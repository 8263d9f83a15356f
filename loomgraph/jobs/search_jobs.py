"""Registered queries on stored indexes. An index of the given tables is kept and used again until their files change."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import english
from loomgraph.jobs import memory_jobs
from loomgraph.jobs.memory_jobs import LIMIT, TERMS
from loomgraph.operators import memory_search
from loomgraph.operators.inverted_index import InvertedIndex
from loomgraph.operators.vector_index import VectorIndex, recall
from loomgraph.sources.derived import kept, shared_folder
from loomgraph.sources.tables import table
from loomgraph.views import AS_OF, memories, with_ctes

NEAREST, LEAST = 3, 0.25
#: Words that the search by stems asks for.
ASKED = ("ents",)


def text_index(spark: SparkSession, sf_dir: str) -> InvertedIndex:
    """The memories' index by tokens."""
    folder = kept(spark, "inverted", [table(spark, sf_dir, "documents")], lambda at: InvertedIndex(spark, at).add(memories(spark, sf_dir)))
    return InvertedIndex(spark, folder)


def vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    e = table(spark, sf_dir, "embeddings")
    return VectorIndex(spark, kept(spark, "cells", [e], lambda at: VectorIndex(spark, at).build(e.select(F.col("vec_id").alias("id"), "embedding"))))


def mem_indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_index(spark, sf_dir).topk(TERMS, LIMIT, AS_OF).select("id", F.round("text_score", 6).alias("text_score"), "rank")


def mem_indexed_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_index(spark, sf_dir).topk(TERMS, LIMIT, AS_OF, project="src0", organization="org1").select("id", F.round("text_score", 6).alias("text_score"), "rank")


def mem_indexed_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid recall whose words are looked up in the index."""
    found = text_index(spark, sf_dir).topk(TERMS, 2 * LIMIT, AS_OF)
    return memory_search.hybrid_recall(memories(spark, sf_dir), memory_jobs.query_vector(spark, sf_dir), TERMS, LIMIT, AS_OF, fulltext=found)


def _changed(spark: SparkSession, sf_dir: str) -> InvertedIndex:
    """An index in three segments: all memories, some of them with new texts, toxic ones removed."""
    m = memories(spark, sf_dir)
    index = InvertedIndex(spark, f"{shared_folder(spark)}/loomgraph/segments-{uuid.uuid4().hex}")
    index.add(m)
    index.add(m.where("id % 5 = 0").withColumn("content", F.concat(F.lit("then that then "), F.coalesce("content", F.lit("")))))
    index.remove(table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")))
    return index


def mem_index_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searching after additions, replacements and removals, before and after compaction."""
    index = _changed(spark, sf_dir)
    before = index.topk(TERMS, 40, AS_OF).select(F.lit("segments").alias("state"), "id", F.round("text_score", 6).alias("text_score"), "rank")
    index.compact()
    return before.unionByName(index.topk(TERMS, 40, AS_OF).select(F.lit("compacted").alias("state"), "id", F.round("text_score", 6).alias("text_score"), "rank"))


def mem_english_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by English stems."""
    folder = kept(spark, "english", [table(spark, sf_dir, "documents")], lambda at: InvertedIndex(spark, at, english.english_stems).add(memories(spark, sf_dir)))
    return InvertedIndex(spark, folder, english.english_stems).topk([english.english_stem(w) for w in ASKED], LIMIT, AS_OF).select("id", F.round("text_score", 6).alias("text_score"), "rank")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), "embedding")


def mem_vector_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact search over cells, for every id that 100 divides."""
    return vector_index(spark, sf_dir).nearest(_queries(spark, sf_dir), NEAREST, LEAST)


def mem_vector_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a search of three quarters of the cells finds nine tenths of what the exact one does, for every id that 100 divides."""
    index = vector_index(spark, sf_dir)
    asked = _queries(spark, sf_dir)
    out = recall(index.nearest(asked, NEAREST, LEAST, exact=False), index.nearest(asked, NEAREST, LEAST))
    return out.select("n_wanted", (10 * F.col("n_found") >= 9 * F.col("n_wanted")).alias("enough"))


QUERIES = {f.__name__: f for f in (mem_indexed_topk, mem_indexed_scoped, mem_indexed_recall, mem_index_changes, mem_english_topk, mem_vector_nearest, mem_vector_recall)}

_FOUND = "SELECT {0}, id, round(text_score, 6) AS text_score, rank::INTEGER AS rank FROM f"
_CHANGED = """changed AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'then that then ' || coalesce(content, '') ELSE content END AS content, expires_at FROM mem WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL))"""
ORACLES = {
    "mem_indexed_topk": memory_jobs.ORACLES["mem_fulltext_topk"],
    "mem_indexed_scoped": with_ctes(f"SELECT id, round(text_score, 6) AS text_score, rank::INTEGER AS rank FROM ({memory_jobs._ft(LIMIT, where="project = 'src0' AND organization = 'org1'")})", "mem"),
    "mem_indexed_recall": memory_jobs.ORACLES["mem_hybrid_recall"],
    "mem_index_changes": with_ctes(f"WITH {_CHANGED}, f AS ({memory_jobs._ft(40).replace('FROM mem', 'FROM changed')}) {_FOUND.format("'segments' AS state")} UNION ALL {_FOUND.format("'compacted' AS state")}", "mem"),
    "mem_vector_nearest": memory_jobs.ORACLES["mem_near_duplicates"],
    "mem_vector_recall": f"SELECT count(*) AS n_wanted, true AS enough FROM ({memory_jobs.ORACLES['mem_near_duplicates']})",
}
