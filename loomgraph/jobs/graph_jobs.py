"""Registered queries on the code graph, indexing, watching and evaluation."""

from __future__ import annotations

import tempfile
import uuid
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import evaluation, frontends, graph, incremental, memory_search
from loomgraph.sources.tables import table
from loomgraph.streaming import watch
from loomgraph.views import file_edges, relationships, symbols, with_ctes

ROOT = "P1"


def _checkpoints(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or a temporary one where it is unset, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return found.rstrip("/") if found else f"file://{tempfile.mkdtemp(prefix='loomgraph-')}"


def impact(spark: SparkSession, sf_dir: str, direction: str, depth: int, start: str = ROOT) -> DataFrame:
    return graph.impact_paths(relationships(spark, sf_dir), start, direction, depth)


def _paths(df: DataFrame) -> DataFrame:
    return df.select("id", "depth", F.round("confidence", 6).alias("confidence"), F.array_join("path", ">").alias("path"), "rel_type", "direction")


def graph_impact_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(impact(spark, sf_dir, "upstream", 4))


def graph_impact_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(impact(spark, sf_dir, "downstream", 3, "C1"))


def graph_impact_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(impact(spark, sf_dir, "both", 2, "C2"))


def graph_impact_depth_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(impact(spark, sf_dir, "upstream", 1))


def graph_impact_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph.impact_summary(impact(spark, sf_dir, "upstream", 4), symbols(spark, sf_dir))
    return out.select("n_paths", "n_files", F.array_join("files", ",").alias("files"), F.array_join("layers", ",").alias("layers"), "risky")


def graph_impact_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact of the first symbol that a name finds."""
    return _paths(graph.impact_by_name(relationships(spark, sf_dir), symbols(spark, sf_dir), "order_1", "upstream"))


def graph_bfs_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reached(relationships(spark, sf_dir), ROOT, 4)


def graph_callers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph.reached(relationships(spark, sf_dir).where("rel_type = 'calls'"), "O1", 3)
    return out.join(symbols(spark, sf_dir), "id").select("id", "depth", "name", "file_path")


def graph_find_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.found_symbols(symbols(spark, sf_dir), "m1_")


def graph_symbols_in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).where(F.col("file_path").like("%services/m1%") & F.col("kind").isin("function", "method")).select("id", "name", "kind")


def graph_layer_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("p"))
    path = F.concat(F.array(*map(F.lit, ("x/Handlers/", "y/user_service", "z/My", "spec/", "pkg/a")))[(F.col("page_id") % 5).cast("int")], F.col("p"))
    return pages.select("page_id", T.layer(path).alias("layer"))


def graph_layer_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.layered(symbols(spark, sf_dir)).groupBy("layer", "kind").agg(F.count(F.lit(1)).alias("n"))


def graph_edge_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relationships(spark, sf_dir).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as a parser gives them: with loops, unknown ends and repetitions."""
    rows = table(spark, sf_dir, "lineitem")
    name = lambda c: F.concat(F.lit("S"), c.cast("string"))
    return rows.select(name(F.col("l_suppkey")).alias("source_id"), name(F.col("l_partkey") % 120 + 1).alias("target_id"), F.when(F.col("l_returnflag") == "R", "calls").otherwise("uses_type").alias("rel_type"), (F.col("l_linenumber") / 10.0).alias("confidence"))


def graph_edge_batch_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cleaned_edges(raw_edges(spark, sf_dir), symbols(spark, sf_dir))


def graph_remove_file_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = graph.without_symbols(symbols(spark, sf_dir), relationships(spark, sf_dir), F.col("file_path") == "src/api/m0.py")
    return edges.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


def graph_remove_project_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, edges = graph.without_symbols(symbols(spark, sf_dir), relationships(spark, sf_dir), F.col("project") == "crm")
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    return one("symbols", left).unionByName(one("edges", edges))


def graph_import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_edges(spark, sf_dir).where("importer <> imported")


def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(file_edges(spark, sf_dir))


def graph_file_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.file_symbols(symbols(spark, sf_dir)).select("project", "file_path", F.array_join("names", "|").alias("names"))


def graph_tour(spark: SparkSession, sf_dir: str) -> DataFrame:
    _checkpoints(spark)
    edges = file_edges(spark, sf_dir).checkpoint()
    return graph.tour_notes(graph.tour(edges), edges).select("stop", "file_path", "in_degree", "reason")


def graph_subclasses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = symbols(spark, sf_dir), relationships(spark, sf_dir).where("rel_type = 'defines'")
    parents = s.where("name = 'ASIA' or name = 'REGION_1' or id = 'R1'").select(F.col("id").alias("source_id"))
    return e.join(parents, "source_id").join(s.withColumnRenamed("id", "target_id"), "target_id").select(F.col("target_id").alias("id"), "name").distinct()


def graph_imported_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_edges(spark, sf_dir).where(F.col("importer").contains("/s1")).select("imported").distinct()


def _part_name(key: str) -> Column:
    """A name of its own for every third part, and one for the others of each four neighbours."""
    k = F.col(key)
    return F.when(k % 3 == 0, F.concat(F.lit("u"), k.cast("string"))).otherwise(F.concat(F.lit("b"), F.floor(k / 4).cast("string")))


def named_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls whose target is a name: from orders to parts."""
    rows = table(spark, sf_dir, "lineitem")
    kind = F.array(*map(F.lit, ("calls", "references", "inherits")))[(F.col("l_orderkey") % 3).cast("int")]
    return rows.select(F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("source_id"), _part_name("l_partkey").alias("target_name"), kind.alias("rel_type"), F.lit(0.8).alias("confidence")).distinct()


def short_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols, some of whose names are ambiguous."""
    return table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), _part_name("p_partkey").alias("name"), F.col("p_brand").alias("file_path"))


def _resolved(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        calls = named_calls(spark, sf_dir).where(F.col("rel_type") == kind)
        return graph.resolved(calls, short_symbols(spark, sf_dir)).select("source_id", "target_id", "rel_type", F.round("confidence", 9).alias("confidence"))

    return query


graph_call_fanout, graph_ref_unique_only, graph_inherit_first = _resolved("calls"), _resolved("references"), _resolved("inherits")


def graph_derived_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, r = symbols(spark, sf_dir), relationships(spark, sf_dir)
    at = s.select("id", "file_path")
    known = r.where("rel_type = 'defines'").join(at.select(F.col("id").alias("source_id"), F.col("file_path").alias("importer")), "source_id").join(at.select(F.col("id").alias("target_id"), F.col("file_path").alias("imported")), "target_id").select("importer", "imported").distinct()
    return graph.derived_imports(r, s, known)


def graph_import_suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_extract("url", r"^[^:]+://([^?#]*)", 1), "/$", "").alias("file_path"))
    return graph.suffix_matched(files.select(F.regexp_extract("file_path", r"([^/]+/[^/]+)$", 1).alias("module")).where("module <> ''"), files)


def import_statements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Imports (importer, module, dots) as orders name them, and the files that customers and suppliers make up."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    ending = F.array(*map(F.lit, (".py", ".ts", "/index.ts", "/__init__.py")))[(F.col("c_custkey") % 4).cast("int")]
    mine = c.select("c_custkey", F.format_string("app/n%d/m%d", "c_nationkey", "c_custkey").alias("stem"), ending.alias("ending"))
    theirs = s.select(F.format_string("lib/n%d/s%d/core_%d.ts", "s_nationkey", "s_suppkey", "s_suppkey").alias("file_path"))
    files = mine.select(F.concat("stem", "ending").alias("file_path")).unionByName(theirs)
    o = table(spark, sf_dir, "orders").join(mine, F.col("o_custkey") == F.col("c_custkey")).select(F.concat("stem", "ending").alias("importer"), (F.col("o_orderkey") % 1000 + 1).alias("t"), (F.col("o_orderkey") % 25).alias("n"), (F.col("o_custkey") % 6).alias("way"))
    module = F.when(F.col("way") == 0, F.format_string("./m%d", "t")).when(F.col("way") == 1, F.format_string("../n%d/m%d", "n", "t")).when(F.col("way") == 2, F.format_string("n%d.m%d", "n", "t"))
    module = module.when(F.col("way") == 3, F.format_string("../../lib/n%d/s%d", "n", F.col("t") % 100 + 1)).when(F.col("way") == 4, F.format_string("app.n%d.m%d", "n", "t")).otherwise(F.format_string("crate.n%d.m%d", "n", "t"))
    return o.select("importer", module.alias("module"), F.when(F.col("way") == 2, 2).otherwise(0).alias("dots")).distinct(), files


def graph_resolve_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolved_imports(*import_statements(spark, sf_dir))


def autoloading_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Ruby class per customer that includes one module per order, named by customers; most files have the name of their class."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    names = c.select(F.col("c_custkey").alias("k"), F.format_string("Sales::V%d::OpenOrders%d", "c_nationkey", "c_custkey").alias("constant"), F.format_string("v%d/open_orders%d.rb", "c_nationkey", "c_custkey").alias("end"))
    path = F.concat(F.when(F.col("k") % 3 == 0, "app/models/sales/").when(F.col("k") % 3 == 1, "lib/").otherwise("bin/run_"), F.when(F.col("k") % 3 == 2, F.regexp_replace("end", "/", "_")).otherwise(F.col("end")))
    used = o.select("o_custkey", (F.col("o_orderkey") % 1000 + 1).alias("k"), "o_orderkey").join(names.select("k", "constant"), "k")
    lines = used.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("  include "), "constant"))), "\n").alias("body"))
    rows = names.join(lines, F.col("k") == F.col("o_custkey"), "left")
    return rows.select(path.alias("file_path"), F.concat(F.lit("class "), "constant", F.lit("\n"), F.coalesce("body", F.lit("")), F.lit("\nend\n")).alias("content"))


def graph_autoloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that Ruby's constants are loaded from by name."""
    files = autoloading_files(spark, sf_dir)
    named = frontends.autoloads(frontends.lines_of(files))
    found = graph.resolved_imports(named.select(F.col("file_path").alias("importer"), "module", F.lit(0).alias("dots")), files.select("file_path"))
    return found.select("importer", "module", "imported")


def graph_prefix_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = symbols(spark, sf_dir).select(F.col("file_path").alias("path"))
    roots = spark.createDataFrame([("src", "all"), ("src/api", "api"), ("lib/utils", "utils"), ("tests", "tests"), ("src/api/m1.py", "one")], "root string, project string")
    return graph.prefix_matched(paths, roots)


def graph_enclosing_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    points = t.select(F.col("l_suppkey").alias("k"), (F.col("l_quantity").cast("int") + F.col("l_linenumber")).alias("line")).distinct()
    spans = t.select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").cast("int").alias("start_line"), (F.col("l_linenumber") * 2 + F.col("l_quantity")).cast("int").alias("end_line")).distinct()
    spans = spans.withColumn("name", F.concat_ws("_", F.lit("f"), "start_line", "end_line"))
    return graph.enclosing(points, spans, ["k"])


def moment(spark: SparkSession, sf_dir: str, share: float) -> str:
    """The moment at a share of the time between the first and the last event."""
    ends = table(spark, sf_dir, "events").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    return str(ends["a"] + timedelta(microseconds=int((ends["b"] - ends["a"]) / timedelta(microseconds=1) * share))) if ends["a"] else "1970-01-01"


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files with their modification times after all events before two moments; an error deletes a file."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file_path"), "ts", "event_type")

    def at(share: float) -> DataFrame:
        last = e.where(F.col("ts") < F.lit(moment(spark, sf_dir, share)).cast("timestamp_ntz")).groupBy("file_path").agg(F.max(F.struct("ts", "event_type")).alias("last"))
        return last.where("last.event_type <> 'error'").select("file_path", F.col("last.ts").alias("mtime"))

    return at(0.5), at(0.75)


def idx_incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.changes(*snapshots(spark, sf_dir))


def idx_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.changes(*snapshots(spark, sf_dir)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def idx_since_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = snapshots(spark, sf_dir)
    return incremental.newer(found, moment(spark, sf_dir, 0.625)).select("file_path")


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), "ts", F.col("event_type").alias("kind"))


def watch_debounce_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.bursts(file_changes(spark, sf_dir), 3_600_000)


def watch_latest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.latest_states(file_changes(spark, sf_dir))


def watch_stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same states from a stream of the events' files, merged batch by batch."""
    folder = f"{shared_folder(spark)}/loomgraph/watch-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/events.parquet*")
    changes = stream.select(F.col("user_id").cast("string").alias("path"), "ts", F.col("event_type").alias("kind"))
    query = watch.follow(changes, f"{folder}/state", f"{folder}/progress")
    query.awaitTermination()
    return watch.state_of(spark, query, f"{folder}/state")


def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one by rank, and which of these have its label."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    near = memory_search.nearest_in_blocks(e.select("id", "embedding"), e.where("id % 100 = 0").select("id", "embedding"), 10, -1.0)
    rows = near.join(e.select("id", "label"), "id").join(e.select(F.col("id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    ranked = F.sort_array(F.collect_list(F.struct("rank", "id", (F.col("label") == F.col("wanted")).alias("good"))))
    lists = rows.groupBy("query_id").agg(ranked.alias("r"))
    return lists.select("query_id", F.transform("r", lambda x: x["id"]).alias("found"), F.transform(F.filter("r", lambda x: x["good"]), lambda x: x["id"]).alias("relevant"))


def eval_recall_precision_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.retrieval_scores(search_results(spark, sf_dir), 5).select("query_id", *[F.round(c, 9).alias(c) for c in ("recall", "precision", "reciprocal_rank")])


def eval_macro_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluation.retrieval_scores(search_results(spark, sf_dir), 5)
    out = s.agg(F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), F.avg("reciprocal_rank").alias("mrr"), F.avg((F.col("reciprocal_rank") > 0).cast("double")).alias("pass_rate"))
    score = evaluation.recall_score(F.col("pass_rate"), F.col("mrr"), F.col("recall"))
    return out.select(*[F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr", "pass_rate")], evaluation.grade(score).alias("grade"))


def eval_latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.nearest_ranks(table(spark, sf_dir, "events"), "event_type", "value", (0.5, 0.95, 0.99))


def eval_rank_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("found"))
    return r.select("l_orderkey", (F.size("found") != F.size(F.array_distinct("found"))).alias("has_duplicates"), F.array_position("found", F.array_max("found")).alias("rank_of_best"))


def ab_token_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", "text")
    return evaluation.paired_totals(c, "conv_id", "role", ["user", "assistant"], F.size(T.tokens(F.col("text"))))


def ab_conversation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events")
    wall = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    return c.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("tool_calls"), F.count(F.lit(1)).alias("turns"), F.round(F.sum("value"), 4).alias("tokens"), wall.alias("wall_us"))


def source_files(spark: SparkSession, sf_dir: str, before: str | None = None) -> DataFrame:
    """One source file per customer, in a language by key: a class, a field and a method per order; of the orders before a moment, if one is given."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit(before).cast("timestamp_ntz") if before else F.lit(True)).select("o_custkey", "o_orderkey").withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    key, order, prev = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("r")).cast("string")
    lang = (F.col("o_custkey") % 4).cast("int")
    call = F.coalesce(F.concat(F.array(*map(F.lit, ("self.run_", "this.run_", "this.run_", "run_")))[lang], prev, F.lit("()")), F.lit("helper()"))
    head = F.array(*map(F.lit, ("    def run_", "  run_", "    public int run_", "  def run_")))[lang]
    open_ = F.array(*map(F.lit, ("(self):", "() {", "() {", "")))[lang]
    close = F.array(*map(F.lit, ("", "\n  }", "\n    }", "\n  end")))[lang]
    indent = F.array(*map(F.lit, ("        ", "    ", "        ", "    ")))[lang]
    end_ = F.array(*map(F.lit, ("", ";", ";", "")))[lang]
    method = F.concat(head, order, open_, F.lit("\n"), indent, call, end_, close)
    body = o.select("o_custkey", "r", method.alias("m")).groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "m"))), lambda x: x["m"]), "\n").alias("body"))
    rows = c.join(body, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("body", F.lit("")).alias("body"))
    k, lang = F.col("c_custkey").cast("string"), (F.col("c_custkey") % 4).cast("int")
    top = F.concat(F.array(*map(F.lit, ("import base\nclass Customer", "import { Base } from './base'\nclass Customer", "import base.Base;\npublic class Customer", "require 'base'\nclass Customer")))[lang], k, F.array(*map(F.lit, ("(Base):", " extends Base {", " extends Base {", " < Base")))[lang])
    field = F.array(*map(F.lit, ("\n    total = 0\n", "\n  total = 0;\n", "\n    private int total = 0;\n", "\n  attr_reader :total\n")))[lang]
    bottom = F.array(*map(F.lit, ("\n", "\n}\n", "\n}\n", "\nend\n")))[lang]
    name = F.concat(F.lit("src/customer"), k, F.array(*map(F.lit, (".py", ".ts", ".java", ".rb")))[lang])
    return rows.select("c_custkey", name.alias("file_path"), F.concat(top, field, "body", bottom).alias("content"))


def parse_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = frontends.parsed_symbols(frontends.lines_of(source_files(spark, sf_dir)))
    return s.groupBy("file_path", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name"))


def parse_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = frontends.parsed_relationships(frontends.lines_of(source_files(spark, sf_dir)))
    return r.groupBy("file_path", "rel_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 6).alias("confidence"))


_NAMES = ("graph_impact_upstream", "graph_impact_downstream", "graph_impact_both", "graph_impact_depth_limit", "graph_impact_rollup", "graph_impact_by_name", "graph_bfs_hops", "graph_callers_of", "graph_find_symbol", "graph_symbols_in_file", "graph_layer_detect", "graph_layer_histogram", "graph_edge_histogram", "graph_edge_batch_clean", "graph_remove_file_cascade", "graph_remove_project_cascade", "graph_import_edges", "graph_degrees", "graph_file_symbols", "graph_tour", "graph_subclasses", "graph_imported_targets", "graph_call_fanout", "graph_ref_unique_only", "graph_inherit_first", "graph_derived_imports", "graph_import_suffix_match", "graph_resolve_imports", "graph_autoloads", "graph_prefix_project", "graph_enclosing_scope", "idx_incremental_diff", "idx_index_stats", "idx_since_filter", "watch_debounce_batch", "watch_latest_states", "watch_stream_states", "eval_recall_precision_mrr", "eval_macro_scores", "eval_latency_percentiles", "eval_rank_assertions", "ab_token_pivot", "ab_conversation_totals", "parse_symbols", "parse_relationships")
QUERIES = {name: globals()[name] for name in _NAMES}


def _impact(start: str, depth: int, direction: str) -> str:
    here, there = ("target_id", "source_id") if direction == "upstream" else ("source_id", "target_id")
    return f"""(SELECT {there} AS id, 1 AS depth, confidence, ['{start}', {there}] AS path, rel_type FROM rel WHERE {here} = '{start}'
  UNION ALL SELECT rel.{there}, i.depth + 1, i.confidence * rel.confidence, list_append(i.path, rel.{there}), rel.rel_type FROM i_{direction} i JOIN rel ON rel.{here} = i.id WHERE i.depth < {depth} AND NOT list_contains(i.path, rel.{there}))"""


def _impact_query(start: str, depth: int, *directions: str) -> str:
    ctes = ",\n".join(f"i_{d} AS {_impact(start, depth, d)}" for d in directions)
    rows = " UNION ALL ".join(f"SELECT id, depth, round(confidence, 6) AS confidence, array_to_string(path, '>') AS path, rel_type, '{d}' AS direction FROM i_{d}" for d in directions)
    return with_ctes(f"WITH RECURSIVE {ctes} {rows}", "rel")


_LAYER_LISTS = {name: [f for f, n in T.LAYER_FOLDERS.items() if n == name] for name in dict.fromkeys(T.LAYER_FOLDERS.values())}


def _layer(path: str) -> str:
    cases = " ".join(f"WHEN list_contains([{', '.join(repr(f) for f in folders)}], p) THEN '{name}'" for name, folders in _LAYER_LISTS.items())
    stem = f"regexp_replace(list_extract(string_split(lower({path}), '/'), -1), '\\.[^.]*$', '')"
    return f"""coalesce(list_extract(list_filter(list_transform(string_split(lower({path}), '/'), lambda p: CASE {cases} END), lambda y: y IS NOT NULL), 1),
  CASE WHEN contains({stem}, 'test') OR contains({stem}, 'spec') THEN 'test' WHEN contains({stem}, 'config') OR contains({stem}, 'settings') THEN 'config' WHEN regexp_matches({stem}, '(controller|handler)$') THEN 'api' WHEN regexp_matches({stem}, 'service$') THEN 'service' WHEN regexp_matches({stem}, '(model|entity|repository)$') THEN 'data' END)"""


_CALLS = "c AS (SELECT DISTINCT 'O' || l_orderkey AS source_id, CASE WHEN l_partkey % 3 = 0 THEN 'u' || l_partkey ELSE 'b' || l_partkey // 4 END AS target_name, list_extract(['calls', 'references', 'inherits'], l_orderkey % 3 + 1) AS rel_type, 0.8::DOUBLE AS confidence FROM lineitem), s AS (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM (SELECT 'P' || p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'u' || p_partkey ELSE 'b' || p_partkey // 4 END AS name, p_brand AS file_path FROM part))"
_AT = lambda share: f"(SELECT make_timestamp(epoch_us(min(ts)) + floor((epoch_us(max(ts)) - epoch_us(min(ts))) * {share})::BIGINT) FROM events)"
_STATE = lambda share: f"SELECT file_path, mtime FROM (SELECT user_id::VARCHAR AS file_path, max(ts) AS mtime, arg_max(event_type, (ts, event_type)) AS kind FROM events WHERE ts < {_AT(share)} GROUP BY 1) WHERE kind <> 'error'"
_SNAP = f"st AS ({_STATE(0.5)}), fo AS ({_STATE(0.75)})"
_DIFF = f"WITH {_SNAP} SELECT coalesce(st.file_path, fo.file_path) AS file_path, CASE WHEN fo.mtime IS NULL THEN 'deleted' WHEN st.mtime IS NULL THEN 'new' WHEN st.mtime <> fo.mtime THEN 'changed' ELSE 'same' END AS state FROM st FULL JOIN fo ON st.file_path = fo.file_path"
_FOUND = "nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, e.label = q.label AS good, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS sim FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)), r AS (SELECT query_id, list(id ORDER BY rank) AS found, coalesce(list(id ORDER BY rank) FILTER (good), []) AS relevant FROM nn WHERE rank <= 10 GROUP BY 1), sc AS (SELECT query_id, CASE WHEN len(relevant) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(found[1:5], relevant)) / len(relevant)::DOUBLE END AS recall, CASE WHEN len(found) = 0 THEN CASE WHEN len(relevant) = 0 THEN 1.0::DOUBLE ELSE 0 END ELSE len(list_intersect(found[1:5], relevant)) / least(5, len(found))::DOUBLE END AS precision, coalesce(1.0::DOUBLE / list_min(list_transform(relevant, lambda x: list_position(found, x))), 0) AS reciprocal_rank FROM r)"
_VARIANTS = ", ".join(f"({i}, '{v}')" for i, v in enumerate(graph.VARIANTS))
_IMPORTS = f"""WITH f AS (SELECT 'app/n' || c_nationkey || '/m' || c_custkey || list_extract(['.py', '.ts', '/index.ts', '/__init__.py'], c_custkey % 4 + 1) AS file_path, c_custkey FROM customer UNION ALL SELECT 'lib/n' || s_nationkey || '/s' || s_suppkey || '/core_' || s_suppkey || '.ts', NULL FROM supplier),
o AS (SELECT file_path AS importer, o_orderkey % 1000 + 1 AS t, o_orderkey % 25 AS n, o_custkey % 6 AS way FROM orders JOIN f ON c_custkey = o_custkey),
i AS (SELECT DISTINCT importer, CASE way WHEN 0 THEN './m' || t WHEN 1 THEN '../n' || n || '/m' || t WHEN 2 THEN 'n' || n || '.m' || t WHEN 3 THEN '../../lib/n' || n || '/s' || (t % 100 + 1) WHEN 4 THEN 'app.n' || n || '.m' || t ELSE 'crate.n' || n || '.m' || t END AS module, CASE WHEN way = 2 THEN 2 ELSE 0 END AS dots FROM o),
p AS (SELECT *, CASE WHEN dots > 0 THEN repeat('../', dots - 1) || replace(module, '.', '/') WHEN starts_with(module, './') OR starts_with(module, '../') THEN module END AS rel FROM i),
r AS (SELECT importer, module, dots, list_reduce(list_prepend('', string_split(regexp_replace(importer, '[^/]*$', '') || rel, '/')), lambda a, x: CASE WHEN x = '..' THEN regexp_replace(a, '/?[^/]*$', '') WHEN x IN ('.', '') THEN a WHEN a = '' THEN x ELSE a || '/' || x END) AS stem FROM p WHERE rel IS NOT NULL),
v(k, variant) AS (VALUES {_VARIANTS}),
a AS (SELECT importer, module, dots, arg_min(file_path, k) AS imported FROM r, v JOIN f ON file_path = stem || variant GROUP BY ALL),
d AS (SELECT importer, module, dots, arg_min(file_path, (length(file_path), file_path)) AS imported FROM r JOIN f ON regexp_extract(file_path, '^(.*)/[^/]*$', 1) = stem GROUP BY ALL),
m AS (SELECT importer, module, dots, replace(module, '.', '/') AS whole, regexp_replace(replace(module, '.', '/'), '^[^/]*/', '') AS rest FROM p WHERE rel IS NULL),
x AS (SELECT file_path, regexp_replace(regexp_replace(file_path, '[.][^./]*$', ''), '/(index|__init__|mod)$', '') AS stem FROM f),
b AS (SELECT importer, module, dots, arg_min(file_path, (part, length(file_path), file_path)) AS imported FROM (SELECT importer, module, dots, whole AS s, 0 AS part FROM m UNION ALL SELECT importer, module, dots, rest, 1 FROM m) JOIN x ON stem = s OR ends_with(stem, '/' || s) GROUP BY ALL)
SELECT importer, module, imported, 'relative' AS how FROM a UNION ALL SELECT importer, module, d.imported, 'relative' FROM d LEFT JOIN a USING (importer, module, dots) WHERE a.imported IS NULL UNION ALL SELECT importer, module, imported, 'absolute' FROM b"""
_TOK = "len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9_]+'), lambda t: t <> ''))"
_PCT = lambda p: f"list_extract(list(value ORDER BY value) FILTER (value IS NOT NULL), round({p} * (count(value) - 1))::BIGINT + 1)"
_ORD = "o AS (SELECT o_custkey, count(*) AS n, min(o_orderkey::VARCHAR) AS first_order, count(*) AS m FROM orders GROUP BY o_custkey), f AS (SELECT c_custkey, 'src/customer' || c_custkey || list_extract(['.py', '.ts', '.java', '.rb'], c_custkey % 4 + 1) AS file_path, coalesce(m, 0) AS m, first_order FROM customer LEFT JOIN o ON c_custkey = o_custkey)"

ORACLES = {
    "graph_impact_upstream": _impact_query(ROOT, 4, "upstream"),
    "graph_impact_downstream": _impact_query("C1", 3, "downstream"),
    "graph_impact_both": _impact_query("C2", 2, "upstream", "downstream"),
    "graph_impact_depth_limit": _impact_query(ROOT, 1, "upstream"),
    "graph_impact_rollup": with_ctes(f"WITH RECURSIVE i_upstream AS {_impact(ROOT, 4, 'upstream')}, j AS (SELECT file_path, {_layer('file_path')} AS layer FROM i_upstream JOIN sym USING (id)), a AS (SELECT count(*) AS n_paths, count(DISTINCT file_path) AS n_files, list_sort(list(DISTINCT file_path)) AS files, list_sort(coalesce(list(DISTINCT layer) FILTER (layer IS NOT NULL), [])) AS layers FROM j) SELECT n_paths, n_files, array_to_string(files, ',') AS files, array_to_string(layers, ',') AS layers, len(layers) >= 3 AS risky FROM a", "rel", "sym"),
    "graph_impact_by_name": with_ctes("WITH RECURSIVE hit AS (SELECT (SELECT id FROM sym WHERE name ILIKE 'order_1' OR regexp_replace(file_path, '^.*/', '') ILIKE 'order_1.%' OR regexp_replace(file_path, '^.*/', '') ILIKE 'order_1' ORDER BY CASE WHEN lower(name) = 'order_1' THEN 0 ELSE 1 END, name, id LIMIT 1) AS h), i AS (SELECT source_id AS id, 1 AS depth, confidence, [h, source_id] AS path, rel_type FROM rel JOIN hit ON target_id = h UNION ALL SELECT rel.source_id, depth + 1, i.confidence * rel.confidence, list_append(path, rel.source_id), rel.rel_type FROM i JOIN rel ON target_id = i.id WHERE depth < 3 AND NOT list_contains(path, rel.source_id)) SELECT id, depth, round(confidence, 6) AS confidence, array_to_string(path, '>') AS path, rel_type, 'upstream' AS direction FROM i", "rel", "sym"),
    "graph_bfs_hops": with_ctes(f"WITH RECURSIVE b AS (SELECT '{ROOT}' AS id, 0 AS depth UNION SELECT rel.source_id, depth + 1 FROM b JOIN rel ON rel.target_id = b.id WHERE depth < 4) SELECT id, min(depth)::INTEGER AS depth FROM b WHERE id <> '{ROOT}' GROUP BY id", "rel"),
    "graph_callers_of": with_ctes("WITH RECURSIVE b AS (SELECT 'O1' AS id, 0 AS depth UNION SELECT rel.source_id, depth + 1 FROM b JOIN rel ON rel.target_id = b.id AND rel_type = 'calls' WHERE depth < 3) SELECT id, min(depth)::INTEGER AS depth, any_value(name) AS name, any_value(file_path) AS file_path FROM b JOIN sym USING (id) WHERE id <> 'O1' GROUP BY id", "rel", "sym"),
    "graph_find_symbol": with_ctes("SELECT id, name, file_path, CASE WHEN lower(name) = 'm1_' THEN 0 ELSE 1 END AS exact_rank FROM sym WHERE name ILIKE 'm1_' OR regexp_replace(file_path, '^.*/', '') ILIKE 'm1_.%' OR regexp_replace(file_path, '^.*/', '') ILIKE 'm1_' ORDER BY exact_rank, name, id LIMIT 50", "sym"),
    "graph_symbols_in_file": with_ctes("SELECT id, name, kind FROM sym WHERE file_path LIKE '%services/m1%' AND kind IN ('function', 'method')", "sym"),
    "graph_layer_detect": f"WITH p AS (SELECT page_id, list_extract(['x/Handlers/', 'y/user_service', 'z/My', 'spec/', 'pkg/a'], page_id % 5 + 1) || regexp_replace(url, '^[a-z]+://', '') AS p0 FROM pages) SELECT page_id, {_layer('p0')} AS layer FROM p",
    "graph_layer_histogram": with_ctes(f"SELECT {_layer('file_path')} AS layer, kind, count(*) AS n FROM sym GROUP BY ALL", "sym"),
    "graph_edge_histogram": with_ctes("SELECT rel_type, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM rel GROUP BY rel_type", "rel"),
    "graph_edge_batch_clean": with_ctes("WITH e AS (SELECT 'S' || l_suppkey AS source_id, 'S' || (l_partkey % 120 + 1) AS target_id, CASE WHEN l_returnflag = 'R' THEN 'calls' ELSE 'uses_type' END AS rel_type, l_linenumber / 10.0::DOUBLE AS confidence FROM lineitem) SELECT source_id, target_id, rel_type, max(confidence) AS confidence FROM e WHERE source_id <> target_id AND source_id IN (SELECT id FROM sym) AND target_id IN (SELECT id FROM sym) GROUP BY ALL", "sym"),
    "graph_remove_file_cascade": with_ctes("WITH s AS (SELECT id FROM sym WHERE file_path <> 'src/api/m0.py') SELECT rel_type, count(*) AS n FROM rel WHERE source_id IN (SELECT id FROM s) AND target_id IN (SELECT id FROM s) GROUP BY rel_type", "sym", "rel"),
    "graph_remove_project_cascade": with_ctes("WITH s AS (SELECT id FROM sym WHERE project <> 'crm') SELECT 'symbols' AS what, count(*) AS n FROM s UNION ALL SELECT 'edges', count(*) FROM rel WHERE source_id IN (SELECT id FROM s) AND target_id IN (SELECT id FROM s)", "sym", "rel"),
    "graph_import_edges": with_ctes("SELECT importer, imported FROM fe WHERE importer <> imported", "fe"),
    "graph_degrees": with_ctes("SELECT file_path, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT importer AS file_path, 0 AS i, 1 AS o FROM fe UNION ALL SELECT imported, 1, 0 FROM fe) GROUP BY file_path", "fe"),
    "graph_file_symbols": with_ctes("SELECT project, file_path, string_agg(name, '|' ORDER BY start_line, id) AS names FROM sym GROUP BY project, file_path", "sym"),
    "graph_subclasses": with_ctes("SELECT DISTINCT c.id, c.name FROM sym p JOIN rel ON p.id = source_id AND rel_type = 'defines' JOIN sym c ON c.id = target_id WHERE p.name IN ('ASIA', 'REGION_1') OR p.id = 'R1'", "sym", "rel"),
    "graph_imported_targets": with_ctes("SELECT DISTINCT imported FROM fe WHERE contains(importer, '/s1')", "fe"),
    "graph_call_fanout": f"WITH {_CALLS} SELECT source_id, id AS target_id, rel_type, round(confidence / n, 9) AS confidence FROM c JOIN s ON name = target_name WHERE rel_type = 'calls'",
    "graph_ref_unique_only": f"WITH {_CALLS} SELECT source_id, id AS target_id, rel_type, round(confidence * 0.8, 9) AS confidence FROM c JOIN s ON name = target_name WHERE rel_type = 'references' AND n = 1",
    "graph_inherit_first": f"WITH {_CALLS} SELECT source_id, (SELECT id FROM s WHERE name = target_name ORDER BY file_path, id LIMIT 1) AS target_id, rel_type, confidence FROM c WHERE rel_type = 'inherits' AND target_name IN (SELECT name FROM s)",
    "graph_derived_imports": with_ctes("WITH e AS (SELECT a.file_path AS importer, b.file_path AS imported, rel_type FROM rel JOIN sym a ON a.id = source_id JOIN sym b ON b.id = target_id) SELECT DISTINCT importer, imported, 0.6::DOUBLE AS confidence FROM e WHERE rel_type IN ('inherits', 'calls', 'uses_type') AND importer <> imported AND (importer, imported) NOT IN (SELECT (importer, imported) FROM e WHERE rel_type = 'defines')", "rel", "sym"),
    "graph_import_suffix_match": "WITH f AS (SELECT regexp_replace(regexp_extract(url, '^[^:]+://([^?#]*)', 1), '/$', '') AS file_path FROM pages), m AS (SELECT DISTINCT regexp_extract(file_path, '([^/]+/[^/]+)$', 1) AS module FROM f WHERE regexp_matches(file_path, '[^/]+/[^/]+$')) SELECT module, arg_min(file_path, (length(file_path), file_path)) AS file_path FROM m JOIN f ON file_path = module OR ends_with(file_path, '/' || module) GROUP BY module",
    "graph_resolve_imports": _IMPORTS,
    "graph_autoloads": """WITH n AS (SELECT c_custkey AS k, 'v' || c_nationkey || '/open_orders' || c_custkey AS stem, CASE c_custkey % 3 WHEN 0 THEN 'app/models/sales/' || stem WHEN 1 THEN 'lib/' || stem ELSE 'bin/run_' || replace(stem, '/', '_') END || '.rb' AS path FROM customer)
  SELECT DISTINCT a.path AS importer, 'sales/' || b.stem AS module, b.path AS imported FROM orders JOIN n a ON a.k = o_custkey JOIN n b ON b.k = o_orderkey % 1000 + 1 WHERE b.k % 3 < 2""",
    "graph_prefix_project": with_ctes("WITH r(root, project) AS (VALUES ('src', 'all'), ('src/api', 'api'), ('lib/utils', 'utils'), ('tests', 'tests'), ('src/api/m1.py', 'one')), p AS (SELECT DISTINCT file_path AS path FROM sym) SELECT path, arg_max(r.project, length(root)) AS project FROM p LEFT JOIN r ON path = root OR starts_with(path, root || '/') GROUP BY path", "sym"),
    "graph_enclosing_scope": "WITH p AS (SELECT DISTINCT l_suppkey AS k, (floor(l_quantity)::INTEGER + l_linenumber)::INTEGER AS line FROM lineitem), s AS (SELECT DISTINCT l_suppkey AS k, l_linenumber::INTEGER AS start_line, floor(l_linenumber * 2 + l_quantity)::INTEGER AS end_line FROM lineitem) SELECT k, line, arg_min('f_' || start_line || '_' || end_line, (end_line - start_line, start_line)) AS name FROM p JOIN s USING (k) WHERE line BETWEEN start_line AND end_line GROUP BY k, line",
    "idx_incremental_diff": _DIFF,
    "idx_index_stats": f"SELECT state, count(*) AS n FROM ({_DIFF}) GROUP BY state",
    "idx_since_filter": f"WITH {_SNAP} SELECT file_path FROM fo WHERE mtime > {_AT(0.625)}",
    "watch_debounce_batch": "WITH e AS (SELECT user_id::VARCHAR AS path, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e) SELECT path, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM r GROUP BY path, run",
    "watch_latest_states": "SELECT user_id::VARCHAR AS path, arg_max(event_type, (ts, event_type)) AS kind, max(ts) AS ts FROM events GROUP BY user_id",
    "watch_stream_states": "SELECT user_id::VARCHAR AS path, arg_max(event_type, (ts, event_type)) AS kind, max(ts) AS ts FROM events GROUP BY user_id",
    "eval_recall_precision_mrr": f"WITH {_FOUND} SELECT query_id, round(recall, 9) AS recall, round(precision, 9) AS precision, round(reciprocal_rank, 9) AS reciprocal_rank FROM sc",
    "eval_macro_scores": f"WITH {_FOUND}, a AS (SELECT avg(recall) AS recall, avg(precision) AS precision, avg(reciprocal_rank) AS mrr, avg(CASE WHEN reciprocal_rank > 0 THEN 1.0::DOUBLE ELSE 0 END) AS pass_rate FROM sc), g AS (SELECT *, 50 * pass_rate + 30 * mrr + 20 * recall AS s FROM a) SELECT round(recall, 6) AS recall, round(precision, 6) AS precision, round(mrr, 6) AS mrr, round(pass_rate, 6) AS pass_rate, CASE WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 70 THEN 'C' WHEN s >= 60 THEN 'D' ELSE 'F' END AS grade FROM g",
    "eval_latency_percentiles": f"SELECT event_type, {_PCT(0.5)} AS p50, {_PCT(0.95)} AS p95, {_PCT(0.99)} AS p99 FROM events GROUP BY event_type",
    "eval_rank_assertions": "WITH f AS (SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS found FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, len(found) <> len(list_distinct(found)) AS has_duplicates, list_position(found, list_max(found))::BIGINT AS rank_of_best FROM f",
    "ab_token_pivot": f"WITH p AS (SELECT conv_id, sum({_TOK}) FILTER (role = 'user') AS u, sum({_TOK}) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id) SELECT count(*) AS pairs, coalesce(sum(u), 0)::BIGINT AS \"user\", coalesce(sum(a), 0)::BIGINT AS assistant, round(100.0::DOUBLE * (sum(a) - sum(u)) / sum(u), 4) AS change_percent FROM p WHERE u IS NOT NULL AND a IS NOT NULL",
    "ab_conversation_totals": "SELECT user_id, count(*) FILTER (event_type = 'click') AS tool_calls, count(*) AS turns, round(sum(value), 4) AS tokens, (epoch_us(max(ts)) - epoch_us(min(ts)))::BIGINT AS wall_us FROM events GROUP BY user_id",
    "parse_symbols": f"WITH {_ORD} SELECT file_path, 'file' AS kind, 1::BIGINT AS n, file_path AS first_name FROM f UNION ALL SELECT file_path, 'class', 1, 'Customer' || c_custkey FROM f UNION ALL SELECT file_path, 'field', 1, 'total' FROM f UNION ALL SELECT file_path, 'method', m, 'run_' || first_order FROM f WHERE m > 0",
    "parse_relationships": f"WITH {_ORD} SELECT file_path, 'defines' AS rel_type, m + 2 AS n, (m + 2)::DOUBLE AS confidence FROM f UNION ALL SELECT file_path, 'imports', 1, 0.3 FROM f UNION ALL SELECT file_path, 'inherits', 1, CASE WHEN c_custkey % 4 IN (1, 2) THEN 0.8 ELSE 0.5 END FROM f UNION ALL SELECT file_path, 'calls', m, 0.5 + (m - 1) FROM f WHERE m > 0",
}
