"""Streams into change logs: restarts, empty sources, replayed batches, compaction."""

import datetime

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import indexing
from loomgraph.sources import change_log
from loomgraph.sources.change_log import ChangeLog
from loomgraph.streaming import watch

CHANGES = "path string, ts timestamp_ntz, kind string"
FILES = "file_path string, mtime timestamp_ntz, content string, removed boolean"


def at(second):
    return datetime.datetime(2024, 1, 1, 0, 0, second)


def followed(spark, root, schema=CHANGES, follow=watch.follow):
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"file://{root}/in")
    query = follow(stream, f"file://{root}/state", f"file://{root}/progress")
    query.awaitTermination()
    return query


def states(spark, root, query):
    return {r.path: (r.kind, r.ts) for r in watch.state_of(spark, query, f"file://{root}/state").collect()}


def test_restart_empty_source_late_changes_and_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(watch, "COMPACT_AT", 2)
    (tmp_path / "in").mkdir()
    assert states(spark, tmp_path, followed(spark, tmp_path)) == {}
    assert states(spark, tmp_path, followed(spark, tmp_path)) == {}
    want = {}
    for i, rows in enumerate([[("a", at(5), "write"), ("b", at(1), "write")], [("a", at(3), "delete"), ("c", at(9), "write")], [("b", at(7), "delete"), ("b", at(2), "write")]]):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
        for p, t, k in rows:
            want[p] = max(want.get(p, (k, t)), (k, t), key=lambda x: x[1])
        query = followed(spark, tmp_path)
        assert states(spark, tmp_path, query) == want
        assert states(spark, tmp_path, followed(spark, tmp_path)) == want  # again, without new data
    log = ChangeLog(spark, f"file://{tmp_path}/state", "path")
    assert log.epoch() == 2 and log.batches() <= 1
    log.vacuum()
    assert states(spark, tmp_path, None) == want


def test_unfollowed_folder(spark, tmp_path):
    with pytest.raises(ValueError, match="nothing"):
        watch.state_of(spark, None, f"file://{tmp_path}/none")


def test_log_replaces_removes_replays(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/log", "k")
    df = lambda *rows: spark.createDataFrame(list(rows), "k string, v int")
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    now = lambda: sorted(map(tuple, ChangeLog(spark, f"file://{tmp_path}/log", "k").current("t").collect()))
    assert log.current("t") is None and log.epoch() == -1
    log.append(0, {"t": df(("a", 1), ("a", 2), ("b", 3))}, keys("a", "b"))
    log.append(1, {"t": df(("a", 4))}, keys("a", "c"))
    assert now() == [("a", 4), ("b", 3)]
    log.append(1, {"t": df(("a", 5), ("c", 6))}, keys("a", "c"))  # the batch again
    assert now() == [("a", 5), ("b", 3), ("c", 6)]
    log.append(2, {"t": df()}, keys("b"))
    assert now() == [("a", 5), ("c", 6)]
    log.compact({"t": log.current("t")})
    assert log.batches() == 0 and now() == [("a", 5), ("c", 6)]
    log.append(3, {"t": df(("b", 7))}, keys("b"))
    log.vacuum()
    assert now() == [("a", 5), ("b", 7), ("c", 6)]


def test_half_written_batch_counts_for_nothing(spark, tmp_path, monkeypatch):
    log = ChangeLog(spark, f"file://{tmp_path}/log", "k")
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    log.append(0, {"t": df}, df)
    monkeypatch.setattr(ChangeLog, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        log.append(1, {"t": df.withColumn("v", F.lit(2))}, df)
    monkeypatch.undo()
    assert ChangeLog(spark, f"file://{tmp_path}/log", "k").current("t").collect() == df.collect()


def test_one_changed_file_writes_its_own_rows_only(spark, tmp_path):
    (tmp_path / "in").mkdir()
    folder = f"file://{tmp_path}/state"
    assert indexing.followed(spark, followed(spark, tmp_path, FILES, indexing.follow), folder).symbols.count() == 0
    first = [(f"m{i}.py", at(1), f"def f{i}():\n    return g{i}()\n", False) for i in range(5)]
    spark.createDataFrame(first, FILES).coalesce(1).write.parquet(f"file://{tmp_path}/in/0")
    followed(spark, tmp_path, FILES, indexing.follow)
    spark.createDataFrame([("m3.py", at(2), "def changed():\n    pass\n", False), ("m4.py", at(2), None, True)], FILES).coalesce(1).write.parquet(f"file://{tmp_path}/in/1")
    query = followed(spark, tmp_path, FILES, indexing.follow)
    batch = max((p.name for p in (tmp_path / "state").glob("batch-*")), key=lambda n: int(n.split("-")[1]))
    assert {r.file_path for r in spark.read.parquet(f"{folder}/{batch}/symbols").collect()} == {"m3.py"}
    names = lambda: {r.name for r in indexing.followed(spark, query, folder).symbols.where("kind <> 'file'").collect()}
    assert names() == {"f0", "f1", "f2", "changed"}
    query = followed(spark, tmp_path, FILES, indexing.follow)  # a restart without new data
    assert names() == {"f0", "f1", "f2", "changed"}
    assert change_log.COMPACT_AT > 1


def test_changes_are_routed_to_the_longest_root(spark, tmp_path):
    """Also after a restart without data, and with a project that is added between two batches."""
    schema = "path string, ts long"
    at = {k: f"{tmp_path}/{k}" for k in ("in", "out", "checkpoint")}
    projects = spark.createDataFrame([("a", "/w/a"), ("b", "/w/a/sub/b")], "project string, root string")
    source = lambda: spark.readStream.schema(schema).parquet(at["in"])
    add = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(at["in"])
    assert watch.routed(spark, at["out"], schema).collect() == []
    add([("/w/a/x.py", 1), ("/w/a/sub/b/y.py", 2), ("/w/ab/z.py", 3), ("/w/a/x.py", 1), (None, 4)])
    for _ in range(2):
        watch.route(source(), projects, at["out"], at["checkpoint"]).awaitTermination()
    add([("/w/ab/z.py", 5), ("/w/a", 6)])
    more = projects.union(spark.createDataFrame([("c", "/w/ab")], projects.schema))
    watch.route(source(), more, at["out"], at["checkpoint"]).awaitTermination()
    rows = watch.routed(spark, at["out"], schema)
    assert sorted((r.ts, r.project) for r in rows.collect()) == [(1, "a"), (1, "a"), (2, "b"), (3, None), (4, None), (5, "c"), (6, "a")]
    assert {r.ts for r in rows.where("project = 'c'").collect()} == {5}
