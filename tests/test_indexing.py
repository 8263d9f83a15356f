"""Indexing a small tree from end to end, again after changes, and from a stream."""

from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import lexer
from loomgraph.functions import text as T
from loomgraph.operators import frontends, graph, indexing

SCHEMA = "file_path string, mtime timestamp_ntz, content string"
T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2)
FIRST = {
    "app/main.py": "from app.lib import work\n\ndef main():\n    work()\n",
    "app/lib.py": "from .utils import clean, Store\n\ndef work():\n    s: Store = clean()\n    twice()\n",
    "app/utils.py": "class Store:\n    size = 0\n    def grow(self):\n        self.size\n\ndef clean():\n    return Store()\n",
    "app/old.py": "def twice():\n    pass\n",
    "notes.txt": "def nothing(): pass\n",
}
SECOND = {**{k: v for k, v in FIRST.items() if k != "app/old.py"}, "app/utils.py": "def clean():\n    return twice()\n", "app/new.py": "def twice():\n    pass\n\ndef main():\n    pass\n"}


def scan(spark, texts, changed=()):
    return spark.createDataFrame([(p, T2 if p in changed else T1, c) for p, c in texts.items()], SCHEMA)


@pytest.fixture(autouse=True, scope="module")
def checkpoints(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def written(spark, index, tmp_path, name):
    index.write(f"file://{tmp_path}/{name}")
    return indexing.Index.read(spark, f"file://{tmp_path}/{name}")


def named(index):
    """Edges as (source, target, type, confidence), with a file's path before a symbol's name."""
    s = index.symbols.select("id", F.when(F.col("kind") == "file", F.col("name")).otherwise(F.concat_ws(":", "file_path", "name")).alias("n"))
    e = indexing.edges(index).join(s.toDF("source_id", "a"), "source_id").join(s.toDF("target_id", "b"), "target_id")
    return {(r.a, r.b, r.rel_type, round(r.confidence, 6)) for r in e.select("a", "b", "rel_type", "confidence").collect()}


@pytest.fixture(scope="module")
def first(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('index')}"
    indexing.parsed(scan(spark, FIRST)).write(folder)
    return indexing.Index.read(spark, folder)


def test_edges_of_a_whole_tree(first):
    found = named(first)
    assert found == {
        ("app/main.py", "app/main.py:main", "defines", 1.0), ("app/lib.py", "app/lib.py:work", "defines", 1.0), ("app/old.py", "app/old.py:twice", "defines", 1.0),
        ("app/utils.py", "app/utils.py:Store", "defines", 1.0), ("app/utils.py", "app/utils.py:clean", "defines", 1.0), ("app/utils.py:Store", "app/utils.py:size", "defines", 1.0), ("app/utils.py:Store", "app/utils.py:grow", "defines", 1.0),
        ("app/main.py", "app/lib.py", "imports", 1.0), ("app/lib.py", "app/utils.py", "imports", 1.0), ("app/lib.py", "app/old.py", "imports", 0.6),
        ("app/main.py", "app/lib.py:work", "uses_type", 0.8), ("app/lib.py", "app/utils.py:clean", "uses_type", 0.8), ("app/lib.py", "app/utils.py:Store", "uses_type", 0.8),
        ("app/main.py:main", "app/lib.py:work", "calls", 0.8), ("app/lib.py:work", "app/utils.py:clean", "calls", 0.8), ("app/lib.py:work", "app/old.py:twice", "calls", 0.5), ("app/lib.py:work", "app/utils.py:Store", "uses_type", 0.8),
        ("app/utils.py:clean", "app/utils.py:Store", "calls", 1.0), ("app/utils.py:grow", "app/utils.py:size", "references", 1.0),
    }


def test_tour_and_impact_over_an_index(spark, first):
    e, s = indexing.edges(first).cache(), first.symbols
    at = s.select("id", "file_path")
    pairs = e.where("rel_type = 'imports'").join(at.toDF("source_id", "importer"), "source_id").join(at.toDF("target_id", "imported"), "target_id").select("importer", "imported")
    assert [r.file_path for r in graph.tour(pairs).orderBy("stop").collect()] == ["app/main.py", "app/lib.py", "app/old.py", "app/utils.py"]
    start = s.where("name = 'clean'").first().id
    callers = graph.impact_paths(e.where("rel_type = 'calls'"), start, "upstream", 3).join(s.select("id", "name"), "id")
    assert {(r.name, r.depth) for r in callers.collect()} == {("work", 1), ("main", 2)}


def test_a_second_scan_equals_a_new_index(spark, first, tmp_path):
    index, states = indexing.reindexed(first, scan(spark, SECOND, ("app/utils.py",)))
    index = written(spark, index, tmp_path, "second")
    assert dict(map(tuple, states.collect())) == {"app/main.py": "same", "app/lib.py": "same", "notes.txt": "same", "app/utils.py": "changed", "app/new.py": "new", "app/old.py": "deleted"}
    assert named(index) == named(written(spark, indexing.parsed(scan(spark, SECOND)), tmp_path, "new"))
    row = indexing.stats(index, indexing.edges(index), states).first()
    assert (row.scanned, row.changed, row.deleted, row.symbols) == (5, 2, 1, 9)


def test_a_followed_stream_equals_a_new_index(spark, tmp_path):
    rows = [[(p, T1, c, False) for p, c in FIRST.items()], [(p, T2, SECOND[p], False) for p in ("app/utils.py", "app/new.py")] + [("app/old.py", T2, None, True), ("app/lib.py", T2, None, False)]]
    schema = SCHEMA + ", removed boolean"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
        query = indexing.follow(stream, f"file://{tmp_path}/state", f"file://{tmp_path}/progress")
        query.awaitTermination()
    assert named(indexing.followed(spark, query, f"file://{tmp_path}/state")) == named(written(spark, indexing.parsed(scan(spark, SECOND)), tmp_path, "new"))


def test_empty_and_odd_files(spark, tmp_path):
    none = written(spark, indexing.parsed(spark.createDataFrame([], SCHEMA)), tmp_path, "none")
    assert indexing.edges(none).count() == none.symbols.count() == 0
    odd = indexing.parsed(spark.createDataFrame([("a.py", T1, None), ("b.py", T1, ""), ("c.py", T1, "class A:\n" * 3)], SCHEMA))
    assert {(r.file_path, r.name) for r in odd.symbols.collect()} == {("c.py", "c.py"), ("c.py", "A")}


def test_ruby_constants_are_loaded_by_name(spark, tmp_path):
    """Superclasses and included modules mean the files that are named after them."""
    row = spark.createDataFrame([("Api::V1::UsersController",), ("::HTTPServer",), ("Plain",), ("",)], "c string").select(T.constant_path(F.col("c")).alias("p")).collect()
    assert [r.p for r in row] == ["api/v1/users_controller", "h_t_t_p_server", "plain", ""]
    assert spark.createDataFrame([("users_controller",), ("",), ("_a",)], "c string").select(T.camel(F.col("c")).alias("p")).collect() == [("UsersController",), ("",), ("A",)]
    texts = {
        "app/controllers/users_controller.rb": "class UsersController < ::ApplicationController\n  include Api::Signed, Timed\n  def show\n  end\nend\n",
        "app/controllers/application_controller.rb": "class ApplicationController < ActionController::Base\nend\n",
        "lib/api/signed.rb": "module Api\n  module Signed\n    # include Timed\n  end\nend\n",
        "lib/timed.rb": "module Timed\nend\n",
        "lib/other.py": "class Other(Timed):\n    pass\n",
    }
    index = written(spark, indexing.parsed(scan(spark, texts)), tmp_path, "ruby")
    found = {(r.file_path, r.module) for r in index.imports.collect()}
    users, app = "app/controllers/users_controller.rb", "app/controllers/application_controller.rb"
    assert found == {(users, "application_controller"), (users, "api/signed"), (users, "timed"), (app, "action_controller/base")}
    paths = index.symbols.where("kind = 'file'").select("id", "file_path")
    e = indexing.edges(index).where("rel_type = 'imports' and confidence = 1.0").join(paths.toDF("source_id", "a"), "source_id").join(paths.toDF("target_id", "b"), "target_id")
    assert {(r.a, r.b) for r in e.collect()} == {(users, app), (users, "lib/api/signed.rb"), (users, "lib/timed.rb")}


def test_facts_of_files_shuffle_them_only(spark):
    """All that files tell is found with two shuffles by file: of the texts, and of what their lines state."""
    rows = frontends.facts(frontends.lines_of(scan(spark, FIRST)))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(file_path") == plan.count("Exchange hashpartitioning") == 2


def test_lines_of_a_file_that_batches_cut(spark):
    """A file's lines nest alike however few rows a batch holds."""
    texts = {**FIRST, "app/long.py": "# a comment first\n" + "class A:\n    def f(self):\n        if x:\n            self.g()\n\n    def g(self):\n        pass\n" * 20, "b.rs": "impl A {\n  fn f() {\n  }\n}\n"}
    rows = lambda: sorted(map(repr, frontends.lines_of(scan(spark, texts)).collect()))
    want, key = rows(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for n in ("1", "7"):
            spark.conf.set(key, n)
            assert rows() == want
    finally:
        spark.conf.set(key, before)
    assert len(want) == 15 + 120 + 4


def test_edges_tell_the_file_of_their_source(first):
    at = first.symbols.select(F.col("id").alias("source_id"), F.col("file_path").alias("at"))
    rows = indexing.edges_of_files(first).join(at, "source_id", "left").collect()
    assert len(rows) == 19 and all(r.at == r.file_path for r in rows)


def test_members_of_a_type_within_the_file_and_elsewhere(spark, tmp_path):
    """A typed variable's member is that of the same file at 1.0, else the only one at 0.8."""
    texts = {"a.py": "class Here:\n    def go(self):\n        pass\n\ndef use(h: Here, f: Far, t: Two):\n    h.go()\n    f.go()\n    t.go()\n", "b.py": "class Far:\n    def go(self):\n        pass\n\nclass Two:\n    def go(self):\n        pass\n", "c.py": "class Two:\n    def go(self):\n        pass\n"}
    index = written(spark, indexing.parsed(scan(spark, texts)), tmp_path, "typed")
    assert {(r.type, r.member, r.rel_type) for r in index.typed.collect()} == {("Far", "go", "calls"), ("Two", "go", "calls")}
    found = {e for e in named(index) if e[0] == "a.py:use" and e[2] == "calls"}
    assert {("a.py:use", "a.py:go", "calls", 1.0)} <= found and ("a.py:use", "b.py:go", "calls", 0.8) in found and ("a.py:use", "c.py:go", "calls", 0.8) not in found


def test_texts_are_scanned_alike_in_batches():
    """Only texts with tokens or open brackets are scanned, each as it is alone."""
    texts = ["def f(a,\n      b):\n    pass\r\n", "x = (1)\n", "# (\ny = [\n2]\n", None, "a \\\n b\n", "f({\n1: 2})\n", "s = 'a(b'\n", ""]
    for language in ("python", "java", "ruby", "rust", "none", None):
        want = [lexer.joined(lexer.masked(t.replace("\r\n", "\n"), language), language) if t and language in lexer.TOKENS else t for t in texts]
        batch = (pa.array(texts, pa.string()), pa.array([language] * len(texts), pa.string()))
        assert [x.to_pylist() for x in lexer._prepared(iter([batch]))] == [want]
    assert lexer._scanned(pa.array(texts[:1]), "python").to_pylist() == ["def f(a,       b):\n\n    pass\n"]
