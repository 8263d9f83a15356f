"""The given tables as memories, symbols, relationships and file changes.

Each view has a Spark form and, in ORACLE_CTES, the same form as DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.tables import table

#: The kinds of memories.
MEMORY_TYPES = ("decision", "pattern", "error_pattern", "preference", "guideline", "outcome", "code_context", "architecture", "incident")
#: The moment at which queries are asked.
AS_OF = "2025-01-01 00:00:00"
#: First path segments of the symbols' files, by key.
FOLDERS = ("src/api", "src/services", "src/models", "lib/utils", "tests/unit", "app/components", "config", "docs")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the embedding and the labels of the same id; both may be missing."""
    d, e, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "labels")
    rows = d.join(e.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left").join(lab.select("doc_id", "quality"), "doc_id", "left")
    return rows.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("content"),
        F.array(*map(F.lit, MEMORY_TYPES))[(F.col("doc_id") % 9).cast("int")].alias("memory_type"),
        F.concat(F.lit("org"), (F.col("doc_id") % 3).cast("string")).alias("organization"),
        F.col("lang").alias("team"),
        F.col("source").alias("project"),
        F.array("lang", "source", F.concat(F.lit("t"), (F.col("doc_id") % 5).cast("string"))).alias("tags"),
        F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.3).otherwise(0.5).alias("importance"),
        (F.col("doc_id") % 11).cast("int").alias("access_count"),
        (F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval((F.col("doc_id") % 730).cast("int"))).alias("created_at"),
        F.when(F.col("doc_id") % 17 == 0, F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")).alias("expires_at"),
        "embedding",
    )


def path_of(key) -> F.Column:
    """The file of the symbols of a key."""
    return F.concat(F.array(*map(F.lit, FOLDERS))[(key % len(FOLDERS)).cast("int")], F.lit("/m"), F.floor(key / 40).cast("string"), F.lit(".py"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols: id, name, kind, file_path, project, start_line, end_line."""
    one = lambda t, prefix, key, name, kind, project: table(spark, sf_dir, t).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.col(name).alias("name") if name else F.concat(F.lit("order_"), F.col(key).cast("string")).alias("name"), F.lit(kind).alias("kind"), path_of(F.col(key).cast("long")).alias("file_path"), F.lit(project).alias("project"), (F.col(key) % 50 * 10 + 1).cast("int").alias("start_line"), (F.col(key) % 50 * 10 + 9).cast("int").alias("end_line"))
    parts = [("region", "R", "r_regionkey", "r_name", "class", "core"), ("nation", "N", "n_nationkey", "n_name", "class", "core"), ("customer", "C", "c_custkey", "c_name", "function", "crm"), ("orders", "O", "o_orderkey", None, "method", "crm"), ("part", "P", "p_partkey", "p_name", "field", "stock"), ("supplier", "S", "s_suppkey", "s_name", "function", "stock")]
    out = one(*parts[0])
    for p in parts[1:]:
        out = out.unionByName(one(*p))
    return out


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges: source_id, target_id, rel_type, confidence; one per pair and type."""
    t = lambda name: table(spark, sf_dir, name)
    named = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    edge = lambda df, s, d, kind, c: df.select(s.alias("source_id"), d.alias("target_id"), F.lit(kind).alias("rel_type"), F.lit(c).alias("confidence"))
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return (
        edge(t("nation"), named("R", "n_regionkey"), named("N", "n_nationkey"), "defines", 1.0)
        .unionByName(edge(t("customer"), named("N", "c_nationkey"), named("C", "c_custkey"), "defines", 1.0))
        .unionByName(edge(t("orders"), named("C", "o_custkey"), named("O", "o_orderkey"), "calls", 0.8))
        .unionByName(edge(lines, named("O", "l_orderkey"), named("P", "l_partkey"), "references", 0.5).distinct())
        .unionByName(edge(lines, named("S", "l_suppkey"), named("P", "l_partkey"), "uses_type", 0.9).distinct())
    )


def file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports between the files of suppliers, parts and orders: importer, imported.

    Suppliers import their parts, a part that of a tenth of its key; a returned
    line makes order and part import each other, which gives cycles.
    """
    lines, py = table(spark, sf_dir, "lineitem"), F.lit(".py")
    name = lambda prefix, key: F.concat(F.lit(f"pkg/{prefix}"), key.cast("string"), py)
    part, tenth, order = F.col("l_partkey"), F.floor(F.col("l_partkey") / 10), F.col("l_orderkey")
    pair = lambda a, b: F.struct(a.alias("importer"), b.alias("imported"))
    returned = (F.col("l_returnflag") == "R") & (part % 50 == 0)
    pairs = F.array(pair(name("s", F.col("l_suppkey")), name("p", part)), pair(name("p", part), name("p", tenth)), F.when(returned, pair(name("o", order), name("p", part))), F.when(returned, pair(name("p", part), name("o", order))))
    return lines.select(F.explode(pairs).alias("pair")).where("pair is not null").select("pair.*").distinct()


_TYPES = ", ".join(f"'{t}'" for t in MEMORY_TYPES)
_FOLDERS = ", ".join(f"'{f}'" for f in FOLDERS)


def _symbol_sql(t: str, prefix: str, key: str, name: str, kind: str, project: str) -> str:
    return f"SELECT '{prefix}' || {key} AS id, {name} AS name, '{kind}' AS kind, list_extract([{_FOLDERS}], {key} % {len(FOLDERS)} + 1) || '/m' || {key} // 40 || '.py' AS file_path, '{project}' AS project, ({key} % 50 * 10 + 1)::INTEGER AS start_line, ({key} % 50 * 10 + 9)::INTEGER AS end_line FROM {t}"


ORACLE_CTES = {
    "mem": f"""mem AS (SELECT d.doc_id AS id, d.text AS content, list_extract([{_TYPES}], d.doc_id % 9 + 1) AS memory_type, 'org' || d.doc_id % 3 AS organization, d.lang AS team, d.source AS project,
  [d.lang, d.source, 't' || d.doc_id % 5] AS tags, CASE quality WHEN 1 THEN 0.9::DOUBLE WHEN 0 THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS importance, (d.doc_id % 11)::INTEGER AS access_count,
  TIMESTAMP '{AS_OF}' - to_days((d.doc_id % 730)::INTEGER) AS created_at, CASE WHEN d.doc_id % 17 = 0 THEN TIMESTAMP '2024-06-01 00:00:00' END AS expires_at, e.embedding
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels USING (doc_id))""",
    "sym": "sym AS (" + " UNION ALL ".join(_symbol_sql(*p) for p in [("region", "R", "r_regionkey", "r_name", "class", "core"), ("nation", "N", "n_nationkey", "n_name", "class", "core"), ("customer", "C", "c_custkey", "c_name", "function", "crm"), ("orders", "O", "o_orderkey", "'order_' || o_orderkey", "method", "crm"), ("part", "P", "p_partkey", "p_name", "field", "stock"), ("supplier", "S", "s_suppkey", "s_name", "function", "stock")]) + ")",
    "rel": """rel AS (SELECT 'R' || n_regionkey AS source_id, 'N' || n_nationkey AS target_id, 'defines' AS rel_type, 1.0::DOUBLE AS confidence FROM nation
  UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, 'defines', 1.0::DOUBLE FROM customer UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey, 'calls', 0.8::DOUBLE FROM orders
  UNION ALL SELECT DISTINCT 'O' || l_orderkey, 'P' || l_partkey, 'references', 0.5::DOUBLE FROM lineitem UNION ALL SELECT DISTINCT 'S' || l_suppkey, 'P' || l_partkey, 'uses_type', 0.9::DOUBLE FROM lineitem)""",
    "fe": "fe AS (SELECT 'pkg/s' || l_suppkey || '.py' AS importer, 'pkg/p' || l_partkey || '.py' AS imported FROM lineitem UNION SELECT 'pkg/p' || l_partkey || '.py', 'pkg/p' || l_partkey // 10 || '.py' FROM lineitem UNION SELECT 'pkg/o' || l_orderkey || '.py', 'pkg/p' || l_partkey || '.py' FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 50 = 0 UNION SELECT 'pkg/p' || l_partkey || '.py', 'pkg/o' || l_orderkey || '.py' FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 50 = 0)",
}


def with_ctes(sql: str, *names: str) -> str:
    """DuckDB SQL in which `WITH` is followed by the named views."""
    head, rest = ("WITH RECURSIVE ", sql.removeprefix("WITH RECURSIVE ")) if sql.startswith("WITH RECURSIVE ") else ("WITH ", sql.removeprefix("WITH ")) if sql.startswith("WITH ") else ("WITH ", None)
    ctes = ",\n".join(ORACLE_CTES[n] for n in names)
    return f"{head}{ctes}\n{sql}" if rest is None else f"{head}{ctes},\n{rest}"
