"""Scoring a parsed index against a ground truth: symbols, edges, impact, edge cases, and the weighted total.

A reference is `file`, `file::name` or, for targets outside the tree, a bare
name. Its file means every path that ends with it, its name the symbol of that
name or of one of its bare forms. Both become equi-joins: paths are listed
under their last segment and those of its endings that may be asked for, names
under their forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.evaluation import grade
from loomgraph.sources.derived import written

#: The ground truth's words for the kinds of symbols; functions and methods stand for one another.
KINDS = {"File": "file", "Function": "call", "Method": "call", "Class": "class", "Struct": "class", "Enum": "class", "Trait": "class", "Interface": "class", "Module": "class", "Object": "class", "Field": "field", "Property": "field", "Attribute": "field"}
#: The types of edges that a ground truth may ask for.
EDGE_KINDS = ("Calls", "Imports", "Defines", "Inherits", "References")
#: What tells an expected edge.
EDGE = ["kind", "source", "target"]
#: Weights of the score's parts.
WEIGHTS = {"symbol_recall": 0.15, "symbol_precision": 0.15, "relationship_recall": 0.15, "relationship_precision": 0.10, "import_resolution": 0.15, "impact_score": 0.15, "edge_case_score": 0.15}


def name_forms(name: Column) -> Column:
    """The names by which a symbol of a ground truth's name may be stored: itself, and what follows the last `.`, the last `::`, the first `#`."""
    after_hash = lambda x: F.substr(x, F.instr(x, "#") + 1)
    colons = F.substring_index(name, "::", -1)
    return F.array_distinct(F.array(name, F.substring_index(name, ".", -1), colons, after_hash(colons), after_hash(name)))


def file_of(ref: Column) -> Column:
    """What stands before the first `::` of a reference."""
    return F.substring_index(ref, "::", 1)


def name_of(ref: Column) -> Column:
    """What stands after the first `::` of a reference; null if there is none."""
    return F.when(ref.contains("::"), F.substr(ref, F.instr(ref, "::") + 2))


def _file_key(ref: Column) -> Column:
    """The key under which `_file_keys` lists the paths that end with a reference to a file: its last segment, or all of it where it names no folder."""
    return F.when(ref.contains("/"), F.concat(F.lit("/"), F.substring_index(ref, "/", -1))).otherwise(ref)


def _file_keys(path: Column, lengths: Column) -> Column:
    """A path's keys: its last segment, which references with a folder share, and the segment's endings of the lengths of references without one."""
    base = F.substring_index(path, "/", -1)
    endings = F.transform(F.filter(lengths, lambda n: n <= F.length(base)), lambda n: F.substr(base, F.length(base) - n + 1))
    return F.concat(F.array(F.concat(F.lit("/"), base)), endings)


def _lengths(ref: Column) -> Column:
    """Aggregates the lengths of references that name no folder, as many as a file's name has characters at most."""
    return F.collect_set(F.when(~ref.contains("/"), F.length(ref)))


def _listed(rows: DataFrame, refs: DataFrame, column: str) -> DataFrame:
    """Rows with a file_path, once under each of the keys (`file_key_`) that the references in the column may have."""
    return rows.crossJoin(F.broadcast(refs.agg(_lengths(F.col(column)).alias("lengths_")))).withColumn("file_key_", F.explode(_file_keys(F.col("file_path"), F.col("lengths_")))).drop("lengths_")  # one row


def matched_files(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs of the refs (file_ref, distinct) and the paths (file_path, distinct) that end with them."""
    keyed = refs.withColumn("file_key_", _file_key(F.col("file_ref")))
    return keyed.join(_listed(files, refs, "file_ref"), "file_key_").where(F.endswith("file_path", F.col("file_ref"))).select("file_ref", "file_path")


def _paths(refs: DataFrame, column: str, symbols: DataFrame) -> DataFrame:
    return matched_files(refs.select(F.col(column).alias("file_ref")).distinct(), symbols.select("file_path").distinct()).withColumnRenamed("file_ref", column)


def _with_found(expected: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `found` to the expected rows; their keys hold no nulls. Rows are sorted by a hash first, which spares comparing long texts that begin alike."""
    by_hash = F.xxhash64(*keys).alias("hash_")
    hits = hits.select(*keys).distinct().select(by_hash, *keys, F.lit(True).alias("found"))
    return expected.select(by_hash, "*").join(hits, ["hash_", *keys], "left").withColumn("found", F.coalesce("found", F.lit(False))).drop("hash_")


def symbol_results(expected: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds `found` to expected symbols (file, name, kind). Unknown kinds are never found; rows may be repeated; nulls count as empty."""
    keys = ["file", "name", "kind"]
    expected = expected.fillna("", keys)
    known = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    asked = expected.select(*keys).distinct().withColumn("class_", F.try_element_at(known, F.col("kind"))).where("class_ is not null")
    asked = asked.withColumn("form_", F.explode(name_forms(F.col("name")))).join(_paths(expected, "file", symbols), "file")
    stored = symbols.select("file_path", F.col("name").alias("form_"), F.when(F.col("kind").isin("function", "method"), "call").otherwise(F.col("kind")).alias("class_"))
    return _with_found(expected, asked.join(stored, ["file_path", "form_", "class_"], "left_semi"), keys)


def _asked(expected: DataFrame, imports_by_file: bool) -> DataFrame:
    """Expected edges without nulls in their keys, and whether their target counts by its file only."""
    return expected.fillna("", EDGE).withColumn("by_file_", (F.col("kind") == "Imports") & F.lit(imports_by_file))


def _edge_hits(asked: DataFrame, symbols: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of the asked edges (EDGE, by_file_) that are there, once each.

    Each source is looked up once, and its edges' targets are listed under
    their names and files; what is asked of it meets them by equal keys, so
    many edges asked of a source with many edges aren't all compared. An
    aggregate, which runs at once, tells which kinds and file names are asked
    for; the asked sources are written.
    """
    target, kept = F.col("target"), list(dict.fromkeys([*keys, *EDGE, "by_file_"]))
    bare = ~F.col("by_file_") & ~target.contains("::") & ~target.contains("/")
    by_file = F.col("by_file_") | ~target.contains("::") & ~bare
    asked = asked.select(*kept).where(F.col("kind").isin(*EDGE_KINDS)).withColumns({"rel_type": F.lower("kind"), "t_file": file_of(target)})
    told = asked.agg(F.collect_set("rel_type").alias("types"), _lengths(F.when(by_file, F.col("t_file"))).alias("lengths"), F.count_if(by_file).alias("files")).first()
    sources = written(asked.select("source", "rel_type").distinct(), "sources")
    refs = sources.select("source").distinct().withColumns({"s_file": file_of(F.col("source")), "s_forms": name_forms(name_of(F.col("source"))), "s_named": F.col("source").contains("::")})
    at = symbols.select("file_path", F.col("id").alias("source_id"), F.col("name").alias("s_name"))
    found = refs.join(_paths(refs, "s_file", symbols), "s_file").join(at, "file_path").where(~F.col("s_named") | F.array_contains("s_forms", F.col("s_name")))
    there = edges.where(F.col("rel_type").isin(*told["types"])).select("source_id", "target_id", "rel_type")
    there = there.join(found.select("source", "source_id").distinct().join(sources, "source"), ["source_id", "rel_type"])
    there = there.join(symbols.select(F.col("id").alias("target_id"), F.col("name").alias("t_name"), F.col("file_path").alias("t_path")), "target_id")
    listed = F.array(F.struct(F.lit(False).alias("of_file_"), F.col("t_name").alias("key_")))
    if told["files"]:
        base = F.array(F.struct(F.lit(True).alias("of_file_"), F.concat(F.lit("/"), F.substring_index("t_path", "/", -1)).alias("key_")))
        listed = F.concat(listed, base)
    if told["lengths"]:
        listed_keys = _file_keys(F.col("t_path"), F.array(*map(F.lit, told["lengths"])))
        endings = F.transform(F.slice(listed_keys, 2, F.size(listed_keys)), lambda k: F.struct(F.lit(True).alias("of_file_"), k.alias("key_")))
        listed = F.when(F.col("t_path").isNull(), listed).otherwise(F.concat(listed, endings))
    by_hash = F.xxhash64("source", "rel_type", "of_file_", "key_").alias("hash_")
    there = there.select("source", "rel_type", "t_name", "t_path", F.inline(listed)).select(by_hash, F.col("source").alias("source_"), F.col("rel_type").alias("type_"), F.when(~F.col("of_file_"), F.col("t_name")).alias("t_name"), "t_path")
    asked = asked.withColumns({"of_file_": by_file, "name_": F.when(bare, target).otherwise(name_of(target))})
    asked = asked.withColumn("key_", F.explode(F.when(F.col("of_file_"), F.array(_file_key(F.col("t_file")))).otherwise(name_forms(F.col("name_"))))).select(by_hash, *kept)
    # Rows meet by the hash of their keys; what it stands for is compared from the columns that they have anyway.
    named = F.array_contains(name_forms(F.when(bare, target).otherwise(name_of(target))), F.col("t_name"))
    fits = [asked["hash_"] == there["hash_"], F.col("source") == F.col("source_"), F.lower("kind") == F.col("type_"), bare | F.endswith("t_path", file_of(target)), F.when(by_file, F.col("t_name").isNull()).otherwise(named)]
    return asked.join(there, fits, "left_semi").select(*keys).distinct()


def relationship_results(expected: DataFrame, symbols: DataFrame, edges: DataFrame, imports_by_file: bool = True) -> DataFrame:
    """Adds `found` to expected edges (kind, source, target; other columns stay).

    An import's target needs to match by its file only, unless
    `imports_by_file` is off. A target without `::` and `/` is a bare name. Edges
    whose target isn't a symbol of the tables aren't seen. The expected edges
    are read several times, so write them first if they cost much.
    """
    asked, keys = _asked(expected, imports_by_file), [*EDGE, "by_file_"]
    return _with_found(asked, _edge_hits(asked, symbols, edges, keys), keys).drop("by_file_")


def relationship_and_case_results(expected: DataFrame, cases: DataFrame, symbols: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The results of expected edges and those of edge cases, whose imports count by name too; both are looked up at once, and what is found is written."""
    asked = [_asked(expected, True), _asked(cases, False)]
    keys = [*EDGE, "by_file_"]
    every = written(asked[0].select(*keys).unionByName(asked[1].select(*keys)).distinct(), "asked-edges")
    hits = written(_edge_hits(every, symbols, edges, keys), "edge-hits")
    r, c = (_with_found(rows, hits, keys).drop("by_file_") for rows in asked)
    return r, c


def counted_results(expected: DataFrame, cases: DataFrame, symbols: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How many expected edges (with a tier) and edge cases, whose imports count by name too, are found: kind, tier, found and n; found and n.

    Equal edges of both are written once with their counts and a number, and
    looked up at once; what is found is told by the numbers.
    """
    keys, must, n = [*EDGE, "by_file_"], F.col("tier") == "must_find", F.count_if
    both = _asked(expected, True).select(*keys, "tier", F.lit(True).alias("edge_")).unionByName(_asked(cases, False).select(*keys, F.lit(None).cast("string").alias("tier"), F.lit(False).alias("edge_")))
    every = both.groupBy(*keys).agg(n(F.col("edge_") & must).alias("must_"), n(F.col("edge_") & ~F.coalesce(must, F.lit(False))).alias("other_"), n(~F.col("edge_")).alias("cases_"))
    every = written(every.withColumn("edge_id_", F.monotonically_increasing_id()), "asked-edges")
    hits = _edge_hits(every, symbols, edges, ["edge_id_"]).withColumn("found", F.lit(True))
    told = every.select("edge_id_", "kind", "must_", "other_", "cases_").join(hits, "edge_id_", "left").groupBy("kind", F.coalesce("found", F.lit(False)).alias("found"))
    told = written(told.agg(*(F.sum(c).alias(c) for c in ("must_", "other_", "cases_"))), "edges-found")
    tiers = F.array(F.struct(F.lit("must_find").alias("tier"), F.col("must_").alias("n")), F.struct(F.lit(None).cast("string").alias("tier"), F.col("other_").alias("n")))
    return told.select("kind", "found", F.inline(tiers)), told.select("found", F.col("cases_").alias("n"))


def arrows(cases: DataFrame, column: str) -> DataFrame:
    """Adds kind, source and target of edges written as `source --Kind--> target`; empty where the text isn't one."""
    part = lambda i: F.trim(F.regexp_extract(F.coalesce(F.col(column), F.lit("")), r"(?s)^(.*?) --(.*?)-->(.*)$", i))
    return cases.withColumns({"source": part(1), "kind": part(2), "target": part(3)})


def impact_recall(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Recall of each query: query_id, expected, hits, recall (1 if nothing is expected).

    Expected entries (query_id, entry; a null entry for a query that expects
    nothing) are references; actual ones are symbols (query_id, file_path,
    name). An entry's name fits whole or by what follows its last `::`, else
    its last `.`.
    """
    asked = expected.select("query_id", "entry", _file_key(file_of(F.col("entry"))).alias("file_key_"))
    there = _listed(actual.select(F.col("query_id").alias("of_query_"), "file_path", "name"), expected.select(file_of(F.col("entry")).alias("file")), "file").withColumnsRenamed({"file_key_": "of_key_", "name": "name_"})
    # What an entry tells is taken from it where it is compared, so only entries are shuffled.
    entry, name = F.col("entry"), F.col("name_")
    ref = name_of(entry)
    bare = F.when(ref.contains("::"), F.substring_index(ref, "::", -1)).otherwise(F.substring_index(ref, ".", -1))
    fits = [F.col("query_id") == F.col("of_query_"), F.col("file_key_") == F.col("of_key_"), F.endswith("file_path", file_of(entry)), ref.isNull() | (name == ref) | (name == bare)]
    rows = asked.join(there, fits, "left").groupBy("query_id", "file_key_", "entry").agg(F.count("of_query_").alias("hits_"))
    out = rows.groupBy("query_id").agg(F.count("entry").alias("expected"), F.count_if(F.col("hits_") > 0).alias("hits"))
    return out.withColumn("recall", F.when(F.col("expected") == 0, 1.0).otherwise(F.try_divide("hits", "expected")))


def scores(symbols: DataFrame, relationships: DataFrame, impacts: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: the parts in percent, their weighted total, its letter, and counts.

    Takes results with `found` (relationships with kind and tier as well),
    impacts with `recall`, edge cases with `passed`; relationships and cases may
    have a column n, the number of equal results that a row stands for. A part
    without any case counts 100; false positives aren't measured, so both
    precisions are 100.
    """
    percent = lambda hit, n: F.coalesce(F.try_divide(100.0 * hit, n), F.lit(100.0))
    n = F.count(F.lit(1))
    s = symbols.agg(percent(F.count_if("found"), n).alias("symbol_recall"), F.count_if("found").alias("symbols_found"), n.alias("symbols_total"))
    imports = F.col("kind") == "Imports"
    counted = lambda df: df if "n" in df.columns else df.withColumn("n", F.lit(1).cast("long"))
    some = lambda where: F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0).cast("long"))
    r = counted(relationships).agg(
        percent(some(F.col("found")), some(F.lit(True))).alias("relationship_recall"),
        percent(some(F.col("found") & imports), some(imports)).alias("import_resolution"),
        some(~F.col("found") & (F.col("tier") == "must_find")).alias("must_find_missed"),
    )
    i = impacts.agg(F.coalesce(100.0 * F.avg("recall"), F.lit(100.0)).alias("impact_score"), F.count_if(F.col("recall") >= 1).alias("impact_queries_correct"))
    e = counted(cases).agg(percent(some(F.col("passed")), some(F.lit(True))).alias("edge_case_score"))
    row = s.crossJoin(r).crossJoin(i).crossJoin(e).withColumns({"symbol_precision": F.lit(100.0), "relationship_precision": F.lit(100.0)})  # one row each
    row = row.withColumn("total", sum((F.col(part) * weight for part, weight in WEIGHTS.items()), F.lit(0.0)))
    return row.withColumn("grade", grade(F.col("total")))
