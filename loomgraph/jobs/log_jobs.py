"""Registered queries on a store that is written to, and on logged conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.jobs.memory_jobs import query_vector
from loomgraph.jobs.tool_jobs import _RECALL, _STORE, ASKED, new_memories
from loomgraph.operators import conversation_logs
from loomgraph.operators.memory_log import MemoryLog
from loomgraph.sources.derived import shared_folder
from loomgraph.sources.tables import table
from loomgraph.views import AS_OF, memories, with_ctes

#: When memories are changed.
CHANGED = "2025-02-01 00:00:00"


def _worked(spark: SparkSession, sf_dir: str) -> tuple[MemoryLog, DataFrame]:
    """A store of all memories after a round of storing, updating, recalling and deleting, and what it answered."""
    m = memories(spark, sf_dir).withColumns({"summary": F.concat(F.lit("about "), F.col("project")), "updated_at": F.lit(None).cast("timestamp_ntz")})
    log = MemoryLog(spark, f"{shared_folder(spark)}/loomgraph/memories-{uuid.uuid4().hex}")
    log.create(m)
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = d.where("doc_id % 50 = 1").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit(None).cast("array<double>").alias("embedding"))
    stored = log.store(new_memories(spark, sf_dir).unionByName(known), AS_OF)
    absent = d.where("doc_id % 100 = 7").select((-F.col("doc_id") - 1).alias("id"))
    updated = log.update(d.where("doc_id % 10 = 3").select(F.col("doc_id").alias("id")).unionByName(absent).withColumn("importance", F.lit(0.95)), CHANGED)
    log.recall(query_vector(spark, sf_dir), ASKED, AS_OF, limit=40, memory_types="decision, pattern,guideline, incident", tags=" en", organization="org1")
    deleted = log.delete(d.where("doc_id % 13 = 5").select(F.col("doc_id").alias("id")).unionByName(absent))
    answer = lambda df, step, done, n: df.select(F.lit(step).alias("step"), "id", F.col(done).alias("done"), n.cast("long").alias("n_contradictions"))
    none = F.lit(None)
    answers = answer(stored, "store", "stored", F.when(F.col("stored"), F.size("contradictions")))
    return log, answers.unionByName(answer(updated, "update", "updated", none)).unionByName(answer(deleted, "delete", "deleted", none))


def tool_log_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memories after the round."""
    log, _ = _worked(spark, sf_dir)
    return log.current().select("id", F.col("access_count").cast("long").alias("access_count"), "importance", F.length("content").cast("long").alias("n_chars"), "updated_at")


def tool_log_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step of the round told of each id."""
    return _worked(spark, sf_dir)[1]


def logged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of a log per turn; some lack their end, usage stands in two places, some turns use a tool."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    usage = F.struct(F.length("text").alias("input_tokens"), F.col("turn").alias("output_tokens"), (F.col("conv_id") % 10).alias("cache_read_input_tokens"))
    at = F.date_format(F.lit(AS_OF).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("turn").cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    blocks = F.when(F.col("turn") % 3 == 0, F.array(F.struct(F.lit("tool_use").alias("type")), F.struct(F.lit("text").alias("type")))).otherwise(F.array(F.struct(F.lit("text").alias("type"))))
    outer = F.when(F.col("conv_id") % 2 == 0, usage)
    json = F.to_json(F.struct("role", at.alias("timestamp"), outer.alias("usage"), F.struct(F.when(F.col("conv_id") % 2 == 1, usage).alias("usage")).alias("message"), blocks.alias("content")))
    return c.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("line_no"), F.when(F.col("turn") % 7 == 5, F.substr(json, F.lit(1), F.length(json) - 1)).otherwise(json).alias("line"))


def ab_log_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, tool calls, turns and times of logged conversations."""
    return conversation_logs.totals(logged_lines(spark, sf_dir))


QUERIES = {f.__name__: f for f in (tool_log_state, tool_log_answers, ab_log_totals)}

_NEW = "new AS (SELECT -a.vec_id - 1 AS id, text FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN documents ON doc_id = a.vec_id WHERE a.vec_id % 100 = 0)"
_ABSENT = "SELECT -doc_id - 1 AS id, false AS done FROM documents WHERE doc_id % 100 = 7"
ORACLES = {
    "tool_log_state": with_ctes(f"""WITH {_NEW}, r AS ({_RECALL}),
  a AS (SELECT id, access_count, importance, content, NULL AS updated_at FROM mem UNION ALL SELECT id, 0, NULL, text, TIMESTAMP '{AS_OF}' FROM new)
  SELECT id, access_count + CASE WHEN id IN (SELECT id FROM r) THEN 1 ELSE 0 END::BIGINT AS access_count, CASE WHEN id >= 0 AND id % 10 = 3 THEN 0.95::DOUBLE ELSE importance END AS importance, length(content)::BIGINT AS n_chars,
  CASE WHEN id >= 0 AND id % 10 = 3 THEN TIMESTAMP '{CHANGED}' ELSE updated_at END AS updated_at FROM a WHERE NOT (id >= 0 AND id % 13 = 5)""", "mem"),
    "tool_log_answers": with_ctes(f"""WITH t AS ({_STORE}) SELECT 'store' AS step, id, true AS done, n_contradictions FROM t
  UNION ALL SELECT 'store', doc_id, false, NULL FROM documents WHERE doc_id % 50 = 1
  UNION ALL SELECT 'update', id, done, NULL FROM (SELECT doc_id AS id, true AS done FROM documents WHERE doc_id % 10 = 3 UNION ALL {_ABSENT})
  UNION ALL SELECT 'delete', id, done, NULL FROM (SELECT doc_id AS id, true AS done FROM documents WHERE doc_id % 13 = 5 UNION ALL {_ABSENT})""", "mem"),
    "ab_log_totals": """WITH m AS (SELECT *, turn IS NOT NULL AND turn % 7 = 5 AS bad, role = 'assistant' AND NOT (turn IS NOT NULL AND turn % 7 = 5) AS own FROM conversations),
  s AS (SELECT conv_id, coalesce(sum(length(text)) FILTER (own), 0)::BIGINT AS input_tokens, coalesce(sum(turn) FILTER (own), 0)::BIGINT AS output_tokens, coalesce(sum(conv_id % 10) FILTER (own), 0)::BIGINT AS cache_read_tokens, 0::BIGINT AS cache_creation_tokens,
  count(*) FILTER (own AND turn % 3 = 0) AS tool_calls, count(*) FILTER (own) AS turns, coalesce(60.0::DOUBLE * (max(turn) FILTER (NOT bad) - min(turn) FILTER (NOT bad)), 0) AS wall_clock_s, count(*) FILTER (bad) AS malformed FROM m GROUP BY conv_id)
  SELECT conv_id, input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens, input_tokens + output_tokens + cache_read_tokens AS total_tokens, tool_calls, turns, wall_clock_s, malformed FROM s""",
}
