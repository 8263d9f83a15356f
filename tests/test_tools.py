"""Storing, recalling and ingesting end to end; scores against ground truths; reports."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import evaluation, graph, ingest, memory_search, memory_tools, parser_scores
from loomgraph.sources import files

AS_OF = "2025-01-01 00:00:00"
SYMBOLS = [
    ("f1", "main.py", "file", "/r/src/main.py"), ("run", "run", "method", "/r/src/main.py"), ("Ctx", "Context", "class", "/r/src/main.py"),
    ("f2", "utils.py", "file", "/r/src/utils.py"), ("helper", "helper", "function", "/r/src/utils.py"), ("q", "Type::make", "method", "/r/src/lib.rs"),
]
EDGES = [("run", "helper", "calls"), ("f1", "f2", "imports"), ("Ctx", "run", "defines"), ("helper", "q", "calls")]


@pytest.fixture
def index(spark):
    return spark.createDataFrame(SYMBOLS, "id string, name string, kind string, file_path string"), spark.createDataFrame(EDGES, "source_id string, target_id string, rel_type string")


@pytest.fixture
def store(spark):
    rows = [(1, "the cats sat on mats", "pets", [1.0, 0.0], "decision"), (2, "dogs bark", "cats too", [0.9, 0.1], "pattern"), (3, "x" * 1999 + "é" + "y" * 50, None, [0.0, 1.0], "decision"), (4, None, None, None, "decision")]
    m = spark.createDataFrame(rows, "id long, content string, summary string, embedding array<float>, memory_type string")
    return m.withColumns({"tags": F.array(F.lit("en")), "organization": F.lit("o"), "project": F.lit("p"), "importance": F.lit(0.5), "access_count": F.lit(0), "created_at": F.lit(AS_OF).cast("timestamp_ntz"), "expires_at": F.lit(None).cast("timestamp_ntz")})


def test_limits_and_lists():
    assert [memory_tools.clamped(v, memory_tools.RECALLED) for v in (None, 0, 7, 99)] == [10, 1, 7, 25]
    assert memory_tools.listed(" a, b ,c") == ["a", "b", "c"] and memory_tools.listed(None) == []
    assert memory_tools.kinds("decision, pattern") == ["decision", "pattern"]
    with pytest.raises(ValueError):
        memory_tools.kinds("decision, rumour")


def test_recall(spark, store):
    vector = spark.createDataFrame([([1.0, 0.0],)], "query_vector array<float>")
    ask = lambda text, **kw: memory_tools.recall(store, vector, text, AS_OF, **kw).collect()
    found = ask("cat")
    assert {(r.id, r.match_type) for r in found} == {(1, "hybrid"), (2, "hybrid"), (3, "semantic")}
    assert next(r for r in found if r.id == 3).content == "x" * 1999 + "...[truncated]"
    assert len(ask("cat", limit=1)) == 1 and [r.id for r in ask("cat", memory_types="pattern")] == [2]
    assert ask("  ") == [] and ask("no_such_name") == []  # a name must have a hit by word
    assert {r.match_type for r in ask("the and")} == {"semantic"}  # stop words alone hit nothing
    assert ask("cat", organization="other") == []


def test_store_tells_contradictions(spark, store):
    new = spark.createDataFrame([(10, "n", [1.0, 0.05]), (11, "m" * 2001, [-1.0, 0.0]), (12, None, None)], "id long, content string, embedding array<float>")
    rows = {r.id: r for r in memory_tools.stored(store, new, AS_OF).collect()}
    assert [(c.id, c.similarity) for c in rows[10].contradictions] == [(1, 1.0), (2, 1.0)]
    assert rows[11].contradictions == [] and rows[11].long_note and not rows[10].long_note and rows[12].long_note is None


def test_nearest_takes_ties_by_id(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(9, 0, -1)] + [(20, [0.0, 1.0])], "id long, embedding array<float>").repartition(3)
    rows = memory_search.nearest_in_blocks(v, v.where("id = 5"), 3, 0.5).orderBy("rank").collect()
    assert [(r.id, r.rank) for r in rows] == [(1, 1), (2, 2), (3, 3)]
    assert memory_search.nearest_in_blocks(v, v.where("id < 0"), 3, 0.5).count() == 0


def test_documents(spark):
    long_ = "word " * 50
    docs = spark.createDataFrame([("d/ADR-1.md", f"\n## A\r\n{long_}\n\n\n## B \nshort" + "\n" * 300), ("d/a.md", f"## a\n{long_}"), ("d/b.md", ""), ("d/c.md", None)], "file_path string, content string")
    known = spark.createDataFrame([("other",), (None,)], "content string")
    out = memory_tools.documents_ingested(known, docs, "proj")
    rows = sorted((r.file_path, r.section_no, r.summary, r.memory_type, r.tags[2], r.state) for r in out.collect())
    assert rows == [
        ("d/ADR-1.md", 0, "d/ADR-1.md", "architecture", "adr-1", "short"), ("d/ADR-1.md", 1, "d/ADR-1.md: A", "architecture", "adr-1", "stored"), ("d/ADR-1.md", 2, "d/ADR-1.md: B", "architecture", "adr-1", "short"),
        ("d/a.md", 0, "d/a.md: a", "code_context", "a", "duplicate"), ("d/c.md", 0, "d/c.md", "code_context", "c", "unreadable"),
    ]
    assert memory_tools.counts(out).first().asDict() == {"memories_stored": 1, "memories_skipped": 4, "errors": 0}
    again = memory_tools.documents_ingested(out.where("state = 'stored'").select("content"), docs, "proj")
    assert memory_tools.counts(again).first().memories_stored == 0


def test_pull_requests(spark):
    body = "b" * 50
    rows = spark.createDataFrame([(1, f'{{"number": 7, "title": "Fix it", "body": "{body}", "author": {{"login": "ann"}}, "url": "u"}}'), (2, f'{{"number": 7, "title": "fix IT", "body": "{body}"}}'), (3, '{"number": 8, "body": "  short  "}'), (4, "not json"), (5, None)], "n long, json string")
    out = memory_tools.pull_requests_ingested(spark.createDataFrame([], "content string"), rows, "me/proj", ["n"]).orderBy("n").collect()
    assert [r.state for r in out] == ["stored", "duplicate", "short", "short", "short"]
    assert (out[0].summary, out[0].content, out[0].memory_type, out[0].project, out[0].author) == ("PR #7: Fix it", f"PR #7: Fix it\n\n{body}", "error_pattern", "proj", "ann")
    with pytest.raises(ValueError):
        memory_tools.pull_requests_ingested(rows, rows, "me/proj/x", ["n"])


def test_repository_names(spark):
    names = ["a/b", "a.b-c/d_e", "a", "a/b/c", "a/", "/b", "a b/c", "a/b\n"]
    assert [ingest.valid_repository(n) for n in names] == [True, True] + [False] * 6
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(ingest.repository_project(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["b", "d_e"] + [None] * 6


def test_stripped(spark):
    texts = ["  a b \n", "　\t\n", "", "a", " x "]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.stripped(F.col("t"))).collect()]
    assert got == [t.strip() for t in texts]


def test_markdown_tree(spark, tmp_path):
    for name, data in {"a.md": b"## x", "sub/B.MD": b"y", "bad.md": b"\xff\xfe", ".next/n.md": b"n", "node_modules/m.md": b"m", "logs/l.md": b"l", "c.txt": b"t"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = {r.file_path: r.content for r in files.markdown(spark, str(tmp_path)).collect()}
    assert rows == {"a.md": "## x", "sub/B.MD": "y", "bad.md": None, "logs/l.md": "l"}


def test_name_forms(spark):
    names = ["Context.invoke", "Controller::new", "Sidekiq::Launcher#run", "Launcher#run", "bare"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", parser_scores.name_forms(F.col("n")).alias("f")).collect()
    want = [{"Context.invoke", "invoke"}, {"Controller::new", "new"}, {"Sidekiq::Launcher#run", "Launcher#run", "run"}, {"Launcher#run", "run"}, {"bare"}]
    assert [set(r.f) for r in rows] == want


def test_symbol_results(spark, index):
    asked = [("main.py", "Context.run", "Function"), ("src/main.py", "Context", "Struct"), ("xsrc/main.py", "Context", "Class"), ("ain.py", "Context", "Trait"), ("main.py", "Context", "Field"), ("main.py", "Context", "Widget"), ("lib.rs", "Type::make", "Method"), ("", "helper", "Function"), (None, None, None)]
    df = spark.createDataFrame(asked + asked[:1], "file string, name string, kind string")
    rows = parser_scores.symbol_results(df, index[0]).collect()
    assert len(rows) == 10
    found = {(r.file, r.name, r.kind) for r in rows if r.found}
    assert found == {asked[0], asked[1], asked[3], asked[6], asked[7]}


def test_relationship_results(spark, index):
    asked = [
        ("Calls", "src/main.py::Context.run", "src/utils.py::helper", "must_find"), ("Calls", "main.py::run", "helper", "must_find"), ("Calls", "main.py", "utils.py::helper", "x"),
        ("Imports", "src/main.py", "src/utils.py::Anything", "x"), ("Imports", "src/main.py", "src/utils.py", "x"), ("Imports", "src/utils.py", "src/main.py", "must_find"),
        ("Inherits", "main.py::run", "helper", "x"), ("Likes", "main.py::run", "helper", "x"), ("Calls", "utils.py::helper", "src/lib.rs::Type::make", "x"), ("Calls", "main.py::run", "src/main.py::helper", "x"),
    ]
    df = spark.createDataFrame(asked, "kind string, source string, target string, tier string")
    rows = parser_scores.relationship_results(df, *index)
    assert {(r.kind, r.source, r.target) for r in rows.collect() if r.found} == {a[:3] for k, a in enumerate(asked) if k in (0, 1, 2, 3, 4, 8)}
    strict = parser_scores.relationship_results(df, *index, imports_by_file=False)
    assert [r.found for r in strict.where("kind = 'Imports'").orderBy("source", "target").collect()] == [True, False, False]
    cases = parser_scores.arrows(spark.createDataFrame([("main.py::run --Calls--> helper",), ("main.py::run -- Calls --> src/utils.py",), ("nothing",), (None,)], "c string"), "c")
    assert sorted((r.c or "", r.found) for r in parser_scores.relationship_results(cases, *index, imports_by_file=False).collect()) == [("", False), ("main.py::run -- Calls --> src/utils.py", True), ("main.py::run --Calls--> helper", True), ("nothing", False)]


def test_edges_asked_of_a_source_meet_its_targets_by_equal_keys(spark):
    """A source of n edges, all asked for, makes rows in proportion to n; comparing all asked edges with all its edges would make n * n."""
    n = 400
    symbols = spark.createDataFrame([("s", "main", "function", "/r/main.py")] + [(f"t{i}", f"f{i}", "function", f"/r/lib/m{i}.py") for i in range(n)], "id string, name string, kind string, file_path string")
    edges = spark.createDataFrame([("s", f"t{i}", "calls") for i in range(n)], "source_id string, target_id string, rel_type string")
    ways = [lambda i: f"f{i}", lambda i: f"lib/m{i}.py", lambda i: f"m{i}.py::f{i}", lambda i: f"lib/m{i + 1}.py::f{i}"]
    expected = spark.createDataFrame([("Calls", "main.py::main", ways[i % 4](i)) for i in range(n)], "kind string, source string, target string")
    out = parser_scores.relationship_results(expected, symbols, edges)
    assert sorted(r.target for r in out.collect() if r.found) == sorted(ways[i % 4](i) for i in range(n) if i % 4 < 3)
    plan = out._jdf.queryExecution().executedPlan()
    out._jdf.collectToPython()
    most, left = 0, [plan]
    while left:
        node = left.pop()
        kind = node.nodeName()
        inner = [node.finalPhysicalPlan()] if kind == "AdaptiveSparkPlan" else [node.plan()] if kind.endswith("QueryStage") else []
        children = node.children()
        left += inner + [children.apply(i) for i in range(children.size())]
        if "Join" in kind and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
    assert 0 < most < 10 * n


def test_files_asked_for_without_folder(spark):
    index = spark.createDataFrame([("a", "run", "function", "src/main.py"), ("b", "run", "function", "lib/domain.py"), ("c", "run", "function", "other.rb"), ("d", None, "function", None)], "id string, name string, kind string, file_path string")
    refs = spark.createDataFrame([("main.py",), ("n.py",), ("",), ("c/main.py",), ("lib/main.py",), ("main.pyx",), ("other.rb",), ("/other.rb",)], "file_ref string")
    pairs = parser_scores.matched_files(refs, index.select("file_path").distinct()).collect()
    files = ["src/main.py", "lib/domain.py", "other.rb"]
    assert sorted(map(tuple, pairs)) == sorted((r.file_ref, f) for r in refs.collect() for f in files if f.endswith(r.file_ref))
    edges = spark.createDataFrame([("a", "b", "imports"), ("a", "c", "imports"), ("a", "d", "imports")], "source_id string, target_id string, rel_type string")
    asked = spark.createDataFrame([("Imports", "main.py", t) for t in ("main.py", "xmain.py", "n.py::no", "", "other.rb", "lib/domain.py")], "kind string, source string, target string")
    assert {r.target for r in parser_scores.relationship_results(asked, index, edges).collect() if r.found} == {"main.py", "n.py::no", "", "other.rb", "lib/domain.py"}
    found, passed = parser_scores.relationship_and_case_results(asked, asked, index, edges)
    assert {r.target for r in found.collect() if r.found} == {"main.py", "n.py::no", "", "other.rb", "lib/domain.py"}
    assert {r.target for r in passed.collect() if r.found} == {r.target for r in parser_scores.relationship_results(asked, index, edges, imports_by_file=False).collect() if r.found}


def test_impact_recall(spark):
    actual = spark.createDataFrame([("q", "/r/a.py", "run"), ("q", "/r/b.rs", "make"), ("w", "/r/a.py", "run")], "query_id string, file_path string, name string")
    expected = spark.createDataFrame([("q", "a.py"), ("q", "b.rs::Type::make"), ("q", "a.py::Ctx.run"), ("q", "a.py::other"), ("w", None), ("v", "a.py")], "query_id string, entry string")
    rows = {r.query_id: (r.expected, r.hits, r.recall) for r in parser_scores.impact_recall(expected, actual).collect()}
    assert rows == {"q": (4, 3, 0.75), "w": (0, 0, 1.0), "v": (1, 0, 0.0)}


def test_scores(spark):
    s = spark.createDataFrame([(True,), (False,)], "found boolean")
    r = spark.createDataFrame([("Calls", "must_find", False), ("Imports", "x", True), ("Calls", "x", True), ("Calls", "x", True)], "kind string, tier string, found boolean")
    i = spark.createDataFrame([(1.0,), (0.5,)], "recall double")
    c = spark.createDataFrame([], "passed boolean")
    row = parser_scores.scores(s, r, i, c).first()
    assert (row.symbol_recall, row.relationship_recall, row.import_resolution, row.impact_score, row.edge_case_score) == (50.0, 75.0, 100.0, 75.0, 100.0)
    assert row.total == pytest.approx(7.5 + 15 + 11.25 + 10 + 15 + 11.25 + 15) and row.grade == "B" and row.must_find_missed == 1 and row.impact_queries_correct == 1
    none = parser_scores.scores(s.limit(0), r.limit(0), i.limit(0), c).first()
    assert none.total == pytest.approx(100) and none.grade == "A"


def test_category_summary(spark):
    results = spark.createDataFrame([("a1", True), ("a2", False), ("c1", True), ("z", True)], "query_id string, passed boolean")
    truth = spark.createDataFrame([("a1", "A"), ("a2", "A"), ("a2", "A"), ("c1", "C"), ("z", "Z"), ("b1", "B")], "query_id string, category string")
    assert sorted(tuple(r) for r in evaluation.category_summary(results, truth).collect()) == [("A - Basic Search Quality", 1, 2), ("C - Filtering", 1, 1)]


def test_report(spark, tmp_path):
    runs = spark.createDataFrame([("t1", "without", 1000, 16), ("t1", "with", 500, 17), ("t1", "with", 250, 0), ("t2", "with", 5, 1), ("t3", "without", 0, 1), ("t3", "with", 9, 1)], "task string, mode string, tokens long, turns long")
    out = evaluation.paired_report(runs, "task", "mode", ("without", "with"), {"tokens": "Total tokens", "turns": "Turns"})
    rows = {r.section: r.markdown for r in out.collect()}
    assert "| Total tokens | 1,000 | 750 | -25.0% |" in rows["t1"] and "| Turns | 16 | 17 | +6.2% |" in rows["t1"]
    assert rows["t2"] == "## t2\n\n> Missing `without` run. Skipping comparison." and "| Total tokens | 0 | 9 | N/A |" in rows["t3"]
    assert "| Total tokens | 1,000 | 759 | -24.1% |" in rows["Aggregate"]
    evaluation.write_report(out, f"file://{tmp_path}/report")
    text = [r.value for r in spark.read.text(f"{tmp_path}/report", wholetext=False).collect()]
    assert [line for line in text if line.startswith("## ")] == ["## t1", "## t2", "## t3", "## Aggregate"]


def test_numbered_and_ranked(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(4)
    for limit in (10, 1000):
        monkeypatch.setattr(graph, "ROWS_IN_A_TASK", limit)
        assert sorted((r.k, r.stop) for r in graph.numbered(df, ["k"], 1000, 5).collect()) == [(k, k + 5) for k in range(1000)]
    paths = spark.createDataFrame([(2, 0.9, "a"), (1, 0.1, "b"), (1, 0.5, "c")], "depth int, confidence double, path string")
    assert [r.path for r in graph.ranked_paths(paths).collect()] == ["c", "b", "a"]


def test_counted_results_score_like_rows(spark):
    """Equal edges are looked up once, and count as often as they are asked for, by tier."""
    index = spark.createDataFrame([("a", "run", "function", "src/main.py"), ("b", "go", "function", "lib/x.py")], "id string, name string, kind string, file_path string")
    edges = spark.createDataFrame([("a", "b", "calls"), ("a", "b", "imports")], "source_id string, target_id string, rel_type string")
    rows = [("Calls", "main.py::run", "x.py::go", "must_find"), ("Calls", "main.py::run", "x.py::go", "should_find"), ("Calls", "main.py::run", "x.py::go", None), ("Calls", "main.py::run", "no", "must_find"), ("Calls", "main.py::run", "no", "must_find"), ("Imports", "main.py", "x.py::no", None), ("Imports", None, "x.py", "must_find"), ("Odd", "main.py", "x.py", "must_find")]
    asked = spark.createDataFrame(rows, "kind string, source string, target string, tier string")
    cases = asked.drop("tier").distinct()
    s, i = spark.createDataFrame([(True,)], "found boolean"), spark.createDataFrame([(1.0,)], "recall double")
    score = lambda both: parser_scores.scores(s, both[0], i, both[1].withColumnRenamed("found", "passed")).first()
    counted = parser_scores.counted_results(asked, cases, index, edges)
    assert counted[0].agg({"n": "sum"}).first()[0] == len(rows) and counted[1].agg({"n": "sum"}).first()[0] == 5
    got = score(counted)
    assert got == score(parser_scores.relationship_and_case_results(asked, cases, index, edges))
    assert (got.relationship_recall, got.must_find_missed) == (62.5, 3)
    assert score(parser_scores.counted_results(asked.limit(0), cases.limit(0), index, edges)).total == pytest.approx(100)
