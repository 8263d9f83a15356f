"""The reference's inline cases and properties of the operators."""

import random
from collections import deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import evaluation, frontends, graph, incremental, ingest, memory_search, memory_store
from loomgraph.sources import files
from loomgraph.streaming import watch


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def edges(spark, rows):
    return spark.createDataFrame([(a, b, "calls", c) for a, b, c in rows], "source_id string, target_id string, rel_type string, confidence double")


def test_impact_chain_and_depth(spark):
    e = edges(spark, [("A", "B", 0.9), ("B", "C", 0.8)])
    rows = {(r.id, r.depth, round(r.confidence, 6)) for r in graph.impact_paths(e, "C", "upstream", 5).collect()}
    assert rows == {("B", 1, 0.8), ("A", 2, 0.72)}
    assert [r.id for r in graph.impact_paths(e, "C", "upstream", 1).collect()] == ["B"]
    assert {(r.id, r.direction) for r in graph.impact_paths(e, "B", "both", 3).collect()} == {("A", "upstream"), ("C", "downstream")}


def test_impact_never_repeats_a_symbol(spark):
    e = edges(spark, [("A", "B", 1.0), ("B", "A", 1.0), ("B", "C", 1.0), ("C", "A", 1.0)])
    rows = graph.impact_paths(e, "A", "upstream", 6).collect()
    assert rows and all(len(set(r.path)) == len(r.path) == r.depth + 1 for r in rows)


def kahn(pairs):
    """Plain FIFO order: entry points by name, targets by name, cycles last."""
    pairs = {(a, b) for a, b in pairs if a != b}
    nodes = sorted({x for p in pairs for x in p})
    left = {n: sum(b == n for _, b in pairs) for n in nodes}
    queue, out = deque(n for n in nodes if not left[n]), []
    while queue:
        n = queue.popleft()
        out.append(n)
        for b in sorted(b for a, b in pairs if a == n):
            left[b] -= 1
            if not left[b]:
                queue.append(b)
    return out + [n for n in nodes if n not in out]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdefg"), st.sampled_from("abcdefg")), min_size=1, max_size=12))
def test_tour_is_kahns_order(spark, pairs):
    pairs = [p for p in pairs if p[0] != p[1]] or [("a", "b")]
    df = spark.createDataFrame(pairs, "importer string, imported string")
    assert [r.file_path for r in graph.tour(df).orderBy("stop").collect()] == kahn(pairs)


def test_tour_of_main_lib_utils(spark):
    df = spark.createDataFrame([("main", "lib"), ("lib", "utils")], "importer string, imported string")
    rows = graph.tour_notes(graph.tour(df, limit=3), df).orderBy("stop").collect()
    assert [r.file_path for r in rows] == ["main", "lib", "utils"]
    assert rows[0].reason.startswith("Entry point") and rows[2].reason == "Imported by 1 file"


def test_layers(spark):
    rows = [("src/api/x.py", "api"), ("a/Services/b.py", "service"), ("x/user_controller.rb", "api"), ("x/OrderRepository.java", "data"), ("x/my_test.py", "test"), ("x/settings.py", "config"), ("x/y.py", None)]
    df = spark.createDataFrame(rows, "p string, want string")
    assert [r.layer for r in df.select(T.layer(F.col("p")).alias("layer")).collect()] == [w for _, w in rows]


def test_fingerprint_ignores_case_and_space(spark):
    df = spark.createDataFrame([("Use  Tokio\n for async", "use tokio for ASYNC "), ("a b", "ab")], "a string, b string")
    assert [r.same for r in df.select((T.fingerprint(F.col("a")) == T.fingerprint(F.col("b"))).alias("same")).collect()] == [True, False]


def test_markdown_sections(spark):
    df = spark.createDataFrame([(1, "plain"), (2, "## A\nx\n## B\ny"), (3, "intro\n## A\nx"), (4, ""), (5, None)], "id int, content string")
    rows = ingest.sections(df).orderBy("id", "section_no").collect()
    assert [(r.id, r.title) for r in rows] == [(1, None), (2, "A"), (2, "B"), (3, None), (3, "A")]


def test_memory_types(spark):
    df = spark.createDataFrame([("adr-001",), ("system-design",), ("CONTRIBUTING",), ("readme",)], "s string")
    assert [r.k for r in df.select(ingest.memory_type_of_stem(F.col("s")).alias("k")).collect()] == ["architecture", "architecture", "guideline", "code_context"]


@pytest.mark.parametrize(("query", "want"), [("parse", True), ("", True), ("fix the parse_file bug", True), ("the HTTPSERVER crash", True), ("12345678 then", True), ("how does it work", False)])
def test_word_guard(spark, query, want):
    df = spark.createDataFrame([(query,)], "q string")
    assert df.select(memory_search.needs_word_hit(F.col("q")).alias("x")).first().x is want


def test_fusion_scores(spark):
    s = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    f = spark.createDataFrame([(2, 1), (3, 2)], "id long, rank int")
    rows = {r.id: r for r in memory_search.fused(s, f).collect()}
    assert rows[2].match_type == "hybrid" and rows[1].match_type == "semantic" and rows[3].match_type == "fulltext"
    assert all(r.rrf <= 2 / 61 for r in rows.values()) and abs(rows[2].rrf - (1 / 62 + 1 / 61)) < 1e-12


def test_update_without_values_changes_nothing(spark):
    m = spark.createDataFrame([(1, 0.5)], "id long, importance double")
    assert memory_store.updated(m, F.col("id") == 1, {}, "2025-01-01") is m


def test_merge_keeps_old_columns(spark):
    old = spark.createDataFrame([(1, "a", "f")], "id long, name string, file string")
    new = spark.createDataFrame([(1, "b", "g"), (2, "c", "h")], "id long, name string, file string")
    assert sorted(map(tuple, memory_store.merged(old, new, ["id"], ["file"]).collect())) == [(1, "b", "f"), (2, "c", "h")]


def test_incremental_states(spark):
    s = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "file_path string, mtime int")
    d = spark.createDataFrame([("a", 1), ("b", 2), ("d", 1)], "file_path string, mtime int")
    assert dict(map(tuple, incremental.changes(s, d).collect())) == {"a": "same", "b": "changed", "c": "deleted", "d": "new"}


def test_retrieval_scores_of_nothing(spark):
    df = spark.createDataFrame([([], []), ([], [1]), ([2, 1], [1])], "found array<long>, relevant array<long>")
    rows = evaluation.retrieval_scores(df, 5).collect()
    assert [(r.recall, r.precision, r.reciprocal_rank) for r in rows] == [(1.0, 1.0, 0.0), (0.0, 0.0, 0.0), (1.0, 0.5, 0.5)]


SOURCES = {
    "app/t.py": "from shop.money import Money, Rate as R\n\nclass Item:\n    cost: int = 0\n    def price(self, r: Rate) -> Money:\n        return Money(self.cost, tax(r))\ndef tax(r):\n    def inner():\n        return tax(0)\n    return r\ndef top():\n    pass\ntop()\n",
    "app/o.ts": "import { Money, Rate } from './money';\nclass Order implements Priced {\n  cost = 0;\n  price(r: Rate): Money {\n    this.seen = true;\n    return this.tax(this.cost, r);\n  }\n  tax(a, b) {\n    return a;\n  }\n}\n",
    "app/inv.py": "import os\nfrom base import Base\n\nclass Invoice(Base):\n    total = 0\n    def add(self, x):\n        self.check(x)\n        return helper(x)\n\n    def check(self, x):\n        return x\n\ndef helper(x):\n    return x\n",
    "app/a.ts": "import { B } from './b';\nexport class A extends B {\n  n: number = 0;\n  run(x: number): void {\n    this.stop(x);\n  }\n  stop(x: number) {\n    go(x);\n  }\n}\nexport const go = (x) => {\n  return x;\n}\n",
    "app/l.rs": "use crate::base::Base;\npub struct Acc {\n    pub total: i64,\n}\nimpl Base for Acc {\n    fn add(&self) {\n        self.total();\n    }\n}\nfn main() {\n    add();\n}\n",
    "app/m.go": "package m\nimport \"fmt\"\ntype Srv struct {\n    Base\n    port int\n}\nfunc (s *Srv) Start() {\n    listen()\n}\nfunc listen() {\n}\n",
    "app/N.java": "import a.Base;\npublic class N extends Base {\n    private int total;\n    public int add(int x) {\n        return check(x);\n    }\n    int check(int x) {\n        return x;\n    }\n}\n",
    "app/k.kt": "import a.Base\nclass K : Base() {\n    val total = 0\n    fun add(x: Int): Int {\n        return check(x)\n    }\n    fun check(x: Int): Int {\n        return x\n    }\n}\n",
    "app/r.rb": "require 'base'\nclass R < Base\n  include Helper\n  attr_reader :total\n  def add(x)\n    check(x)\n  end\n  def check(x)\n    x\n  end\nend\n",
}


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame(list(SOURCES.items()), "file_path string, content string")
    lines = frontends.lines_of(df).cache()
    symbols = frontends.parsed_symbols(lines).cache()
    return symbols.collect(), frontends.parsed_relationships(lines, symbols).collect()


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("app/inv.py", {("Invoice", "class"), ("total", "field"), ("add", "method"), ("check", "method"), ("helper", "function")}),
        ("app/a.ts", {("A", "class"), ("n", "field"), ("run", "method"), ("stop", "method"), ("go", "function")}),
        ("app/l.rs", {("Acc", "class"), ("total", "field"), ("Acc::add", "method"), ("main", "function")}),
        ("app/m.go", {("Srv", "class"), ("port", "field"), ("Start", "method"), ("listen", "function")}),
        ("app/t.py", {("Item", "class"), ("cost", "field"), ("price", "method"), ("tax", "function"), ("inner", "function"), ("top", "function")}),
        ("app/o.ts", {("Order", "class"), ("cost", "field"), ("price", "method"), ("tax", "method")}),
        ("app/N.java", {("N", "class"), ("total", "field"), ("add", "method"), ("check", "method")}),
        ("app/k.kt", {("K", "class"), ("total", "field"), ("add", "method"), ("check", "method")}),
        ("app/r.rb", {("R", "class"), ("total", "field"), ("add", "method"), ("check", "method")}),
    ],
)
def test_symbols(parsed, path, want):
    found = {(r.name, r.kind) for r in parsed[0] if r.file_path == path and r.kind != "file"}
    assert found == want


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("app/inv.py", {("Invoice", "Base", "inherits", 0.8), ("app/inv.py", "Base", "uses_type", 0.8), ("app/inv.py", "base", "imports", 0.3), ("app/inv.py", "os", "imports", 0.3), ("add", "check", "calls", 1.0), ("add", "helper", "calls", 1.0)}),
        ("app/a.ts", {("A", "B", "inherits", 0.8), ("app/a.ts", "./b", "imports", 0.3), ("run", "stop", "calls", 1.0), ("stop", "go", "calls", 1.0)}),
        ("app/l.rs", {("Acc", "Base", "inherits", 0.8), ("app/l.rs", "crate::base::Base", "imports", 0.3), ("Acc::add", "Acc::total", "calls", 0.6), ("main", "add", "calls", 0.5)}),
        ("app/m.go", {("Srv", "Base", "inherits", 0.5), ("app/m.go", "fmt", "imports", 0.3), ("Start", "Srv", "uses_type", 1.0), ("Start", "listen", "calls", 1.0)}),
        ("app/N.java", {("N", "Base", "inherits", 0.8), ("app/N.java", "a.Base", "imports", 0.3), ("add", "check", "calls", 1.0)}),
        ("app/k.kt", {("K", "Base", "inherits", 0.8), ("app/k.kt", "a.Base", "imports", 0.3), ("add", "check", "calls", 1.0), ("add", "Int", "uses_type", 0.5), ("check", "Int", "uses_type", 0.5)}),
        ("app/r.rb", {("R", "Base", "inherits", 0.5), ("R", "Helper", "inherits", 0.5), ("app/r.rb", "base", "imports", 0.3), ("add", "check", "calls", 1.0)}),
        ("app/t.py", {("app/t.py", "shop.money", "imports", 0.3), ("app/t.py", "Money", "uses_type", 0.8), ("app/t.py", "Rate", "uses_type", 0.8), ("price", "Rate", "uses_type", 0.8), ("price", "Money", "uses_type", 0.8), ("price", "cost", "references", 1.0), ("price", "Money", "calls", 0.8), ("price", "tax", "calls", 1.0), ("inner", "tax", "calls", 1.0), ("app/t.py", "top", "calls", 1.0)}),
        ("app/o.ts", {("app/o.ts", "./money", "imports", 0.3), ("Order", "Priced", "inherits", 0.5), ("price", "Rate", "uses_type", 0.8), ("price", "Money", "uses_type", 0.8), ("price", "cost", "references", 1.0), ("price", "tax", "calls", 1.0)}),
    ],
)
def test_relationships(parsed, path, want):
    found = {(r.source, r.target, r.rel_type, r.confidence) for r in parsed[1] if r.file_path == path and r.rel_type != "defines"}
    assert found == want


def test_definitions_belong_to_their_class_or_file(parsed):
    found = {(r.source, r.target) for r in parsed[1] if r.rel_type == "defines"}
    assert found == {(r.parent or r.file_path, r.name) for r in parsed[0] if r.kind != "file"}
    spans = {(r.name, r.kind): (r.start_line, r.end_line, r.parent) for r in parsed[0] if r.file_path == "app/t.py"}
    assert spans["Item", "class"] == (3, 6, None) and spans["price", "method"] == (5, 6, "Item") and spans["inner", "function"] == (8, 9, "tax") and spans["tax", "function"] == (7, 10, None)


def test_source_tree_skips_hidden_and_other_files(spark, tmp_path):
    for p in ("a/x.py", "a/.git/y.py", "node_modules/z.py", "a/readme.md", "b/T.TS"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x = 1\n")
    rows = files.tree(spark, f"file://{tmp_path}", tuple(frontends.EXTENSIONS)).collect()
    assert sorted(r.file_path for r in rows) == ["a/x.py", "b/T.TS"]


def test_versioned_table(spark, tmp_path):
    t = files.VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.version() == -1
    t.replace(spark.range(3))
    old = t.read()
    t.replace(spark.range(5))
    assert (t.version(), t.read().count(), old.count()) == (1, 5, 3)


def test_json_lines_skips_broken_ones(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in files.json_lines(spark, str(tmp_path / "c.jsonl"), "a long").collect()) == [1, 2]


def test_namespace():
    assert files.valid_namespace("my_schema1") and not files.valid_namespace("1a") and not files.valid_namespace("") and not files.valid_namespace("a-b") and not files.valid_namespace("a" * 64)


def test_stream_of_bursts(spark, tmp_path):
    spark.createDataFrame([("a", "2024-01-01 00:00:00.0"), ("a", "2024-01-01 00:00:00.3"), ("a", "2024-01-01 00:00:02"), ("b", "2024-01-01 00:01:00")], "path string, ts string").select("path", F.col("ts").cast("timestamp_ntz").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, ts timestamp_ntz").parquet(str(tmp_path / "in"))
    q = watch.stream_bursts(stream).writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted((r.path, r.n) for r in spark.table("bursts").collect()) == [("a", 1), ("a", 2)]


def test_truncated_by_bytes(spark):
    texts = ["a" * 2000, "a" * 2001, "é" * 1000, "é" * 1001, "a" + "é" * 1500, "ab" + "日" * 900, "abc" + "🎉" * 600, "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in rows.select("i", T.truncated(F.col("t")).alias("c")).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert got[i] == (t if len(raw) <= 2000 else raw[:2000].decode(errors="ignore") + "...[truncated]")


def test_imports_are_resolved(spark):
    files = ["pkg/a/x.py", "pkg/b/__init__.py", "pkg/b/c.py", "web/ui/index.ts", "web/ui/list.tsx", "web/router/router.ts", "web/router/zz_other.ts", "web/main.ts", "lib/deep/pkg/a/x.py", "src/controller.rs", "top.py"]
    imports = [("pkg/a/x.py", "b", 2), ("pkg/a/x.py", "b.c", 2), ("pkg/a/x.py", "nothing", 1), ("web/main.ts", "./ui", 0), ("web/main.ts", "./ui/list", 0), ("web/main.ts", "./router", 0), ("web/ui/list.tsx", "../main", 0), ("web/main.ts", "../../../top", 0), ("top.py", "pkg.a.x", 0), ("top.py", "a.x", 0), ("top.py", "kg.a.x", 0), ("src/main.rs", "bat.controller", 0), ("top.py", "pkg.b", 0), ("top.py", "left-pad", 0)]
    out = graph.resolved_imports(spark.createDataFrame(imports, "importer string, module string, dots int"), spark.createDataFrame([(f,) for f in files], "file_path string"))
    got = {(r.importer, r.module): r.imported for r in out.collect()}
    assert got == {
        ("pkg/a/x.py", "b"): "pkg/b/__init__.py", ("pkg/a/x.py", "b.c"): "pkg/b/c.py", ("web/main.ts", "./ui"): "web/ui/index.ts", ("web/main.ts", "./ui/list"): "web/ui/list.tsx", ("web/main.ts", "./router"): "web/router/router.ts",
        ("web/ui/list.tsx", "../main"): "web/main.ts", ("web/main.ts", "../../../top"): "top.py", ("top.py", "pkg.a.x"): "pkg/a/x.py", ("top.py", "a.x"): "pkg/a/x.py", ("top.py", "kg.a.x"): "pkg/a/x.py", ("src/main.rs", "bat.controller"): "src/controller.rs", ("top.py", "pkg.b"): "pkg/b/__init__.py",
    }


def test_nearest_ranks(spark):
    rows = [("one", 5.0), ("null", None), ("same", 2.0), ("same", 2.0), (None, 1.0)] + [("many", float((7 * k) % 1000) ** 2) for k in range(1000)] + [("ties", float(k // 300)) for k in range(1000)]
    got = {r.k: (r.p50, r.p95, r.p99) for r in evaluation.nearest_ranks(spark.createDataFrame(rows, "k string, v double"), "k", "v", (0.5, 0.95, 0.99)).collect()}
    for key in ("one", "same", "many", "ties"):
        v = sorted(x for k, x in rows if k == key)
        assert got[key] == tuple(v[int(p * (len(v) - 1) + 0.5)] for p in (0.5, 0.95, 0.99))
    assert got["null"] == (None, None, None)


def test_new_content_has_its_fingerprint(spark):
    rows = spark.createDataFrame([(1, "Old  Text", "x", None, None), (2, "b", "y", None, None)], "id int, content string, content_fingerprint string, updated_at timestamp_ntz, last_accessed_at timestamp_ntz").withColumn("access_count", F.lit(0))
    out = memory_store.updated(rows, F.col("id") == 1, {"content": F.lit("new TEXT")}, "2024-01-01 00:00:00")
    got = {r.id: r for r in out.withColumn("want", T.fingerprint(F.lit("New text"))).collect()}
    assert got[1].content_fingerprint == got[1].want and got[2].content_fingerprint == "y"
    seen = {r.id: (r.access_count, r.last_accessed_at is None) for r in memory_store.bumped(rows, rows.where("id = 2"), "2024-01-01 00:00:00").collect()}
    assert seen == {1: (0, True), 2: (1, False)}


def test_folders_are_listed_before_files_are_read(spark, tmp_path):
    """Names with an underscore are found; skipped folders and other endings are neither listed nor opened."""
    for name in ("pkg/__init__.py", "pkg/_own.py", "_under/k.py", "a b/ü %.py", "pkg/c.txt", "node_modules/z.py", ".hid/q.py", "pkg/.dot.py"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(f"# {name}")
    (tmp_path / "pkg" / "bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / "loop").symlink_to(tmp_path)
    want = {"pkg/__init__.py", "pkg/_own.py", "_under/k.py", "a b/ü %.py"}
    found = files.listed(spark, str(tmp_path), ("py",))
    assert {r.file_path for r in found.collect()} == want | {"pkg/bad.py"}
    (tmp_path / "pkg" / "bad.py").unlink()
    assert {r.file_path: r.content for r in files.with_content(spark, str(tmp_path), found).collect()} == {w: f"# {w}".encode() for w in want}
    rows = files.tree(spark, f"file://{tmp_path}", ("py",)).collect()
    assert {r.file_path: r.content for r in rows} == {w: f"# {w}" for w in want}
    assert all(abs(r.mtime.timestamp() - (tmp_path / r.file_path).stat().st_mtime) < 1 for r in rows)
    (tmp_path / "none").mkdir()
    assert files.tree(spark, str(tmp_path / "none"), ("py",)).collect() == []


def test_enclosing_by_blocks(spark):
    """The innermost of overlapping spans, as comparing every pair finds it, without a join on the key alone."""
    rng = random.Random(5)
    spans = [(rng.randrange(3), a := rng.randrange(-40, 60), a + rng.randrange(-2, 1 << rng.randrange(7)), rng.choice("abc")) for _ in range(300)] + [(1, 7, 7, "x"), (2, None, 5, "n")]
    points = [(k, n) for k in range(4) for n in range(-50, 130)] + [(0, None)]
    got = graph.enclosing(spark.createDataFrame(points, "k int, line int"), spark.createDataFrame(spans, "k int, start_line int, end_line int, name string"), ["k"])
    want = {}
    for k, n in points:
        held = [(e - s, s, name) for j, s, e, name in spans if j == k and None not in (n, s) and s <= n <= e]
        if held:
            want[k, n] = min(held)[2]
    assert {(r.k, r.line): r.name for r in got.collect()} == want
