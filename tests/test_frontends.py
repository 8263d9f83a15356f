"""Front ends on text that misleads line patterns, on typed variables, and against the parser of Python itself."""

import ast
import sysconfig
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomgraph.functions.lexer import joined, masked
from loomgraph.operators import frontends, indexing

FIELDS = {
    "src/invoice.py": "class Invoice:\n    amount: int = 0\n    currency: str = ''\n\n    def total(self):\n        return self.amount\n",
    "src/account.rs": "pub struct Account {\n    pub balance: i64,\n}\n\nimpl Account {\n    pub fn double(&self) -> i64 {\n        self.balance * 2\n    }\n}\n",
    "src/server.go": "package server\n\ntype Server struct {\n\tAddress string\n}\n\nfunc (s *Server) Label() string {\n\treturn s.Address\n}\n",
}
ODD = {
    "d.py": '"""def no():\nclass No:\n"""\nfrom a import (\n    B,\n    C as D,\n)\nclass E(\n    B,\n    Mix,\n):\n    """class Never:"""\n    def f(\n        self,\n        x: "str" = "(",\n    ):\n        return g("h(x)")  # k(y)\n',
    "I.java": "package p;\ninterface I {\n    int one(int x);\n    String two(\n        int a,\n        int b\n    ) throws E;\n}\nclass J {\n    int three(int a,\n              int b) {\n        String s = \"} class Q {\";\n        /* void gone() {\n        } */\n        return four(a);\n    }\n}\n",
    "t.ts": "class T {\n  run(\n    a: string,\n    b: number,\n  ): void {\n    const s = `function no() {\n    }`;\n    go(a);\n  }\n  next() {\n    return 1;\n  }\n}\n",
    "g.go": "package g\nimport (\n\t\"fmt\"\n\t\"os\"\n)\nfunc Run(\n\ta int,\n\tb int,\n) {\n\tfmt.Println(\"func no() {\")\n}\n",
    "k.kt": "class A(val x: Int) : B(x, 1), C\nclass D : E {\n    fun f() = 1\n}\n",
    "r.rs": "fn main() {\n    let s = r#\"fn no() {\n    struct No\"#;\n    let c = '{';\n    other();\n}\nfn other<'a>(x: &'a str) {\n}\n",
    "r.rb": "class R\n  def a\n    x = <<~TXT\n      def no\n      class No\n    TXT\n    b # def c\n  end\n  def b\n    1\n  end\nend\n",
}
TYPED = {
    "m/money.py": "class Money:\n    amount = 0\n    def plus(self, other):\n        return other\n",
    "m/use.py": "from m.money import Money\ndef total(m: Money):\n    return m.amount + m.plus(m).amount\ndef make():\n    x = Money(1)\n    x.amount = 3\n    return x.plus(x)\ndef other(m):\n    return m.amount\n",
}


def parse(spark, files):
    df = spark.createDataFrame(list(files.items()), "file_path string, content string")
    lines = frontends.lines_of(df).cache()
    symbols = frontends.parsed_symbols(lines).cache()
    return symbols.collect(), frontends.parsed_relationships(lines, symbols).collect()


def test_fields_and_their_readers(spark):
    """Ten symbols, four definitions and three reads of fields, in three languages."""
    symbols, edges = parse(spark, FIELDS)
    have = {(r.file_path, r.name, r.kind) for r in symbols}
    want = {("src/invoice.py", "Invoice", "class"), ("src/invoice.py", "total", "method"), ("src/invoice.py", "amount", "field"), ("src/invoice.py", "currency", "field"), ("src/account.rs", "Account", "class"), ("src/account.rs", "Account::double", "method"), ("src/account.rs", "balance", "field"), ("src/server.go", "Server", "class"), ("src/server.go", "Label", "method"), ("src/server.go", "Address", "field")}
    assert want <= have
    found = {(r.file_path, r.source, r.target, r.rel_type) for r in edges}
    defines = {("src/invoice.py", "Invoice", "amount"), ("src/invoice.py", "Invoice", "currency"), ("src/account.rs", "Account", "balance"), ("src/server.go", "Server", "Address")}
    reads = {("src/invoice.py", "total", "amount"), ("src/account.rs", "Account::double", "balance"), ("src/server.go", "Label", "Address")}
    assert {(*x, "defines") for x in defines} | {(*x, "references") for x in reads} <= found


@pytest.fixture(scope="module")
def odd(spark):
    return parse(spark, ODD)


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("d.py", {("E", "class", 8), ("f", "method", 13)}),
        ("I.java", {("I", "class", 2), ("one", "method", 3), ("two", "method", 4), ("J", "class", 9), ("three", "method", 10)}),
        ("t.ts", {("T", "class", 1), ("run", "method", 2), ("next", "method", 10)}),
        ("g.go", {("Run", "function", 6)}),
        ("k.kt", {("A", "class", 1), ("D", "class", 2), ("f", "method", 3)}),
        ("r.rs", {("main", "function", 1), ("other", "function", 7)}),
        ("r.rb", {("R", "class", 1), ("a", "method", 2), ("b", "method", 9)}),
    ],
)
def test_symbols_of_odd_text(odd, path, want):
    assert {(r.name, r.kind, r.start_line) for r in odd[0] if r.file_path == path and r.kind != "file"} == want


def test_edges_of_odd_text(odd):
    found = {(r.file_path, r.source, r.target, r.rel_type) for r in odd[1]}
    assert {("d.py", "E", "B", "inherits"), ("d.py", "E", "Mix", "inherits"), ("d.py", "d.py", "C", "uses_type"), ("d.py", "f", "g", "calls"), ("I.java", "three", "four", "calls"), ("t.ts", "run", "go", "calls"), ("g.go", "g.go", "fmt", "imports"), ("g.go", "g.go", "os", "imports"), ("k.kt", "A", "B", "inherits"), ("k.kt", "A", "C", "inherits"), ("k.kt", "D", "E", "inherits"), ("r.rs", "main", "other", "calls")} <= found
    assert not {x for x in found if x[2] in ("h", "k", "no", "No", "gone", "import", "x", "Q")}


def test_members_of_typed_variables(spark):
    df = spark.createDataFrame([(p, None, c) for p, c in TYPED.items()], "file_path string, mtime timestamp_ntz, content string")
    from loomgraph.sources.derived import shared_folder

    shared_folder(spark)
    index = indexing.parsed(df)
    names = index.symbols.select("id", "name")
    e = indexing.edges(index).join(names.toDF("source_id", "source"), "source_id").join(names.toDF("target_id", "target"), "target_id")
    found = {(r.source, r.target, r.rel_type, r.confidence) for r in e.where("target in ('amount', 'plus')").where("rel_type <> 'defines'").collect()}
    assert {("total", "amount", "references", 0.8), ("total", "plus", "calls", 0.8), ("make", "plus", "calls", 0.8)} <= found
    assert not {x for x in found if x[2] == "references" and x[0] in ("make", "other")}


@pytest.mark.parametrize("language", ["python", "typescript", "rust", "go", "java", "kotlin", "ruby"])
def test_lines_keep_their_numbers(language):
    for text in [*ODD.values(), *FIELDS.values(), "((\n", "))\n", "\n\n(a\n\nb)\nc", '"""', "`", "'", "", "\\\n\\\n"]:
        out = joined(masked(text, language), language)
        assert out.count("\n") == text.count("\n")


def test_against_the_parser_of_python(spark):
    """Classes and functions of 40 files of the standard library, no more and no fewer."""
    files, want = {}, set()
    for p in sorted(Path(sysconfig.get_paths()["stdlib"]).glob("*.py"))[:40]:
        text = p.read_text(encoding="utf-8")
        files[p.name] = text
        for node in ast.walk(ast.parse(text)):
            if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                want.add((p.name, node.name, node.lineno))
    df = spark.createDataFrame(list(files.items()), "file_path string, content string").repartition(8)
    got = {(r.file_path, r.name, r.start_line) for r in frontends.parsed_symbols(frontends.lines_of(df)).where(F.col("kind").isin("class", "function", "method")).collect()}
    assert got == want


def test_files_of_one_partition_are_dealt_to_tasks_and_matched_once(spark):
    """Few bytes of a table may make much text, which one task shouldn't parse; and symbols need one pass over the files."""
    df = spark.range(40).coalesce(1).select(F.format_string("f%d.py", "id").alias("file_path"), F.lit("class A:\n    def run(self):\n        pass\n").alias("content"))
    lines = frontends.lines_of(df)
    assert lines.select(F.spark_partition_id()).distinct().count() > 1
    plan = frontends.parsed_symbols(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_prepared(") == 1 and "Window" not in plan
