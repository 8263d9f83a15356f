"""A store that is written to, by one or several writers; logged conversations."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import conversation_logs
from loomgraph.operators.memory_log import MemoryLog
from loomgraph.sources.change_log import COMPACT_AT

T0, T1, T2 = "2025-01-01 00:00:00", "2025-01-02 00:00:00", "2025-01-03 00:00:00"
SCHEMA = "id string, content string, content_fingerprint string, summary string, memory_type string, tags array<string>, organization string, project string, importance double, embedding array<float>, access_count int, created_at timestamp_ntz, updated_at timestamp_ntz, last_accessed_at timestamp_ntz, expires_at timestamp_ntz"


def memories(spark, rows):
    return spark.createDataFrame(rows, "id string, content string, embedding array<float>").selectExpr(
        "id", "content", "'old' AS content_fingerprint", "CAST(NULL AS STRING) AS summary", "'decision' AS memory_type", "array('t') AS tags", "'o' AS organization", "'p' AS project", "0.5D AS importance", "embedding",
        "0 AS access_count", f"CAST('{T0}' AS TIMESTAMP_NTZ) AS created_at", "CAST(NULL AS TIMESTAMP_NTZ) AS updated_at", "CAST(NULL AS TIMESTAMP_NTZ) AS last_accessed_at", "CAST(NULL AS TIMESTAMP_NTZ) AS expires_at",
    )


@pytest.fixture
def log(spark, tmp_path):
    out = MemoryLog(spark, f"file://{tmp_path}/memories")
    out.create(memories(spark, [("a", "cats sleep", [1.0, 0.0]), ("b", "dogs bark", [0.0, 1.0]), ("c", None, None)]))
    return out


def counts(log):
    return {r.id: r.access_count for r in log.current().collect()}


def test_a_new_store(spark, log):
    assert {r.id: (r.content, r.access_count) for r in log.current().collect()} == {"a": ("cats sleep", 0), "b": ("dogs bark", 0), "c": (None, 0)}
    with pytest.raises(ValueError):
        log.create(log.current())


def test_stored_memories_get_ids(spark, log):
    new = spark.createDataFrame([("cats doze", [0.9, 0.1]), ("x" * 2001, [-1.0, -1.0])], "content string, embedding array<float>")
    told = {len(r.contradictions): r for r in log.store(new, T1).collect()}
    near = told[1]
    assert near.stored and not near.long_note and [(c.id, c.similarity, c.content) for c in near.contradictions] == [("a", 0.99, "cats sleep")]
    assert told[0].stored and told[0].long_note
    rows = {r.id: r for r in log.current().collect()}
    assert {uuid.UUID(near.id), uuid.UUID(told[0].id)} == {uuid.UUID(i) for i in rows if len(i) > 1}
    assert rows[near.id].content == "cats doze" and rows[near.id].access_count == 0 and str(rows[near.id].created_at) == T1 and rows[near.id].tags is None


def test_given_ids_are_stored_once(spark, log):
    new = spark.createDataFrame([("a", "again", None), ("d", "new", None), ("d", "new", None), (None, "nobody", None)], "id string, content string, embedding array<float>")
    assert {(r.id, r.stored) for r in log.store(new, T1).collect()} == {("a", False), ("d", True), (None, False)}
    assert sorted((r.id, r.content) for r in log.current().collect() if r.content) == [("a", "cats sleep"), ("b", "dogs bark"), ("d", "new")]


def test_ids_of_numbers_must_be_given(spark, tmp_path):
    numbered = MemoryLog(spark, f"file://{tmp_path}/numbers")
    numbered.create(memories(spark, [("1", "x", None)]).withColumn("id", F.col("id").cast("long")))
    with pytest.raises(ValueError):
        numbered.store(spark.createDataFrame([("y", None)], "content string, embedding array<float>"), T1)


def test_recall_counts_what_it_tells(spark, log):
    vector = spark.createDataFrame([([1.0, 0.0],)], "query_vector array<float>")
    found = log.recall(vector, "cats", T1, limit=1).collect()
    assert [(r.id, r.access_count) for r in found] == [("a", 0)]
    assert log.recall(vector, " ", T1).count() == 0
    log.recall(vector, "cats", T2, limit=1)
    assert counts(log) == {"a": 2, "b": 0, "c": 0}
    assert {r.id: str(r.last_accessed_at) for r in log.current().collect()} == {"a": T2, "b": "None", "c": "None"}
    log.update(spark.createDataFrame([("a", "cats run")], "id string, content string"), T2)  # the count goes into the new row
    log.recall(vector, "cats", T2, limit=1)
    assert counts(log)["a"] == 3


def test_update_tells_what_is_missing(spark, log):
    changes = spark.createDataFrame([("a", "cats run", None), ("a", "cats", None), ("b", None, 0.9), ("z", "?", None), (None, "?", None)], "id string, content string, importance double")
    assert {(r.id, r.updated, r.reason) for r in log.update(changes, T1).collect()} == {("a", True, None), ("b", True, None), ("z", False, "not found")}
    rows = {r.id: r for r in log.current().collect()}
    assert rows["a"].content == "cats run" and rows["a"].importance == 0.5 and rows["a"].content_fingerprint != "old" and str(rows["a"].updated_at) == T1
    assert rows["b"].content == "dogs bark" and rows["b"].importance == 0.9 and len(rows) == 3
    with pytest.raises(ValueError):
        log.update(changes.select("id"), T1)


def test_deleted_memories_are_gone_and_may_come_back(spark, log):
    ids = spark.createDataFrame([("a",), ("z",)], "id string")
    assert {(r.id, r.deleted, r.reason) for r in log.delete(ids).collect()} == {("a", True, None), ("z", False, "not found")}
    assert set(counts(log)) == {"b", "c"}
    log.store(spark.createDataFrame([("a", "back", None)], "id string, content string, embedding array<float>"), T1).collect()
    assert {r.id: r.content for r in log.current().collect()} == {"a": "back", "b": "dogs bark", "c": None}


def test_a_slower_writer_starts_from_the_faster_ones_version(spark, log):
    """Both writers begin at the same version; the slower one's change is made anew, and nothing is lost."""
    other = MemoryLog(spark, log.log.folder)
    seen = []

    def made():
        rows = log.current().where("id = 'b'").withColumn("importance", F.col("importance") + 0.1)
        seen.append(log.log.epoch())
        if len(seen) == 1:
            other.update(spark.createDataFrame([("b", 0.7)], "id string, importance double"), T1)
        return {"rows": rows, "bumps": log._bumps(rows.limit(0), T1)}, rows

    version, _ = log.log.commit(made)
    assert seen == [0, 1] and version == 2
    assert {r.id: round(r.importance, 3) for r in log.current().collect()} == {"a": 0.5, "b": 0.8, "c": 0.5}


def test_a_version_is_taken_once(spark, log):
    assert log.log._taken(7, "batch", "x") and not log.log._taken(7, "batch", "y")


def test_the_log_is_compacted(spark, log):
    vector = spark.createDataFrame([([1.0, 0.0],)], "query_vector array<float>")
    for _ in range(COMPACT_AT):
        log.recall(vector, "cats", T1, limit=1)
    assert log.log.batches() == 0 and counts(log)["a"] == COMPACT_AT
    log.log.vacuum()
    assert counts(log) == {"a": COMPACT_AT, "b": 0, "c": 0}


def test_logged_conversations(spark):
    use, text = {"type": "tool_use"}, {"type": "text"}
    logs = {
        "nested": [{"role": "user", "timestamp": "2025-01-01T00:00:00Z"}, {"role": "assistant", "usage": {}, "message": {"usage": {"input_tokens": 3, "output_tokens": 2}}, "content": [use, text, use, "x", 1]}, {"role": "assistant", "usage": {"cache_read_input_tokens": 5, "cache_creation_input_tokens": 7, "input_tokens": "many"}, "message": {"usage": {"input_tokens": 100}}, "content": "tool_use", "timestamp": "2025-01-01T01:00:00.26+01:00"}],
        "user": [{"role": "user", "usage": {"input_tokens": 3}, "content": [use]}, {"timestamp": ""}],
        "times": [{"timestamp": "2025-01-01T00:00:09Z"}, {"timestamp": None}, {"timestamp": "2025-01-01T00:00:02Z"}],
        "unread": [{"timestamp": "2025-01-01T00:00:00Z"}, {"timestamp": "soon"}],
        "odd": [[1], 3, None, "text", {"role": "assistant"}],
    }
    rows = [(k, i, json.dumps(v)) for k, vs in logs.items() for i, v in enumerate(vs)] + [("odd", 9, "{"), ("odd", 10, " \t"), ("odd", 11, ""), ("odd", 12, None), ("blank", 0, " ")]
    got = {r[0]: tuple(r)[1:] for r in conversation_logs.totals(spark.createDataFrame(rows, "conv_id string, line_no int, line string")).collect()}
    assert got == {
        "nested": (3, 2, 5, 7, 17, 2, 2, 0.3, 0),
        "user": (0, 0, 0, 0, 0, 0, 0, 0.0, 0),
        "times": (0, 0, 0, 0, 0, 0, 0, -7.0, 0),
        "unread": (0, 0, 0, 0, 0, 0, 0, 0.0, 0),
        "odd": (0, 0, 0, 0, 0, 0, 1, 0.0, 5),
    }
