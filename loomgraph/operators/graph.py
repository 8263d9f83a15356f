"""The code graph: impact, lookup, reading order, resolution and cleaning of edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import layer


def impact_paths(edges: DataFrame, start: str, direction: str, depth: int) -> DataFrame:
    """All simple paths of at most `depth` edges from a symbol: id, depth, confidence, path, rel_type, direction.

    Upstream follows edges from target to source, downstream from source to
    target, both gives the two one after the other. Confidences multiply. Each
    hop is one equi-join of the frontier, so an edge table bucketed by its ends
    needs no shuffle; AQE broadcasts a small frontier.
    """
    if direction == "both":
        return impact_paths(edges, start, "upstream", depth).unionByName(impact_paths(edges, start, "downstream", depth))
    here, there = ("target_id", "source_id") if direction == "upstream" else ("source_id", "target_id")
    step = edges.select(F.col(here).alias("at"), F.col(there).alias("next"), F.col("rel_type").alias("type_"), F.col("confidence").alias("c_"))
    level = step.where(F.col("at") == start).select(F.col("next").alias("id"), F.lit(1).alias("depth"), F.col("c_").alias("confidence"), F.array(F.lit(start), F.col("next")).alias("path"), F.col("type_").alias("rel_type"))
    out = level
    for d in range(2, depth + 1):
        joined = level.join(step, level["id"] == step["at"]).where(~F.array_contains("path", F.col("next")))
        level = joined.select(F.col("next").alias("id"), F.lit(d).alias("depth"), (F.col("confidence") * F.col("c_")).alias("confidence"), F.array_append("path", F.col("next")).alias("path"), F.col("type_").alias("rel_type"))
        out = out.unionByName(level)
    return out.withColumn("direction", F.lit(direction))


def ranked_paths(paths: DataFrame) -> DataFrame:
    """Impact paths, the nearest first, then the surest; ties by path."""
    return paths.orderBy("depth", F.desc("confidence"), "path")


def impact_by_name(edges: DataFrame, symbols: DataFrame, name: str, direction: str, depth: int = 3, kind: str | None = None, project: str | None = None) -> DataFrame:
    """Impact paths of the first symbol that a name finds; depth is kept between 1 and 10. Without a hit, no rows."""
    hit = found_symbols(symbols, name, kind, project, limit=1).first()
    paths = impact_paths(edges, hit["id"] if hit else "", direction, max(1, min(10, depth)))
    return paths if hit else paths.limit(0)


def reached(edges: DataFrame, start: str, hops: int) -> DataFrame:
    """Symbols within so many hops upstream, each once with its least depth: id, depth."""
    step = edges.select(F.col("target_id").alias("at"), F.col("source_id").alias("next")).distinct()
    seen = edges.sparkSession.createDataFrame([(start, 0)], "id string, depth int")
    frontier = seen
    for d in range(1, hops + 1):
        found = frontier.join(step, frontier["id"] == step["at"]).select(F.col("next").alias("id")).distinct()
        frontier = found.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def impact_summary(paths: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: n_paths, n_files, files and layers (distinct, sorted), risky (3 or more layers)."""
    rows = paths.select("id").join(symbols.select("id", "file_path"), "id").withColumn("layer", layer(F.col("file_path")))
    out = rows.agg(F.count(F.lit(1)).alias("n_paths"), F.sort_array(F.collect_set("file_path")).alias("files"), F.sort_array(F.collect_set("layer")).alias("layers"))
    return out.select("n_paths", F.size("files").cast("long").alias("n_files"), "files", "layers", (F.size("layers") >= 3).alias("risky"))


def found_symbols(symbols: DataFrame, name: str, kind: str | None = None, project: str | None = None, limit: int = 50) -> DataFrame:
    """Symbols by name or file name, case-insensitive with live `%` and `_`; exact names first."""
    base = F.regexp_replace("file_path", "^.*/", "")
    rows = symbols.where(F.col("name").ilike(name) | base.ilike(f"{name}.%") | base.ilike(name))
    rows = rows.where(F.col("kind") == kind) if kind else rows
    rows = rows.where(F.col("project") == project) if project else rows
    exact = F.when(F.lower("name") == name.lower(), 0).otherwise(1)
    return rows.select("id", "name", "file_path", exact.alias("exact_rank")).orderBy("exact_rank", "name", "id").limit(limit)


def cleaned_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges without loops and unknown ends, the highest confidence of each (source, target, type)."""
    ids = symbols.select("id")
    rows = edges.where(F.col("source_id") != F.col("target_id"))
    rows = rows.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return rows.groupBy("source_id", "target_id", "rel_type").agg(F.max("confidence").alias("confidence"))


def without_symbols(symbols: DataFrame, edges: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges after the symbols for which `gone` holds are removed; their edges go too."""
    left = symbols.where(~gone)
    ids = left.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return left, kept


def degrees(file_edges: DataFrame) -> DataFrame:
    """Importers and imports of each file: file_path, in_degree, out_degree (0 where none)."""
    out = file_edges.select(F.col("importer").alias("file_path"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    both = out.unionByName(file_edges.select(F.col("imported").alias("file_path"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return both.groupBy("file_path").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def file_symbols(symbols: DataFrame) -> DataFrame:
    """Names of each file's symbols in the order of their lines."""
    ordered = F.sort_array(F.collect_list(F.struct("start_line", "id", "name")))
    return symbols.groupBy("project", "file_path").agg(F.transform(ordered, lambda s: s["name"]).alias("names"))


#: So many rows may be put in order in one task.
ROWS_IN_A_TASK = 100_000


def numbered(df: DataFrame, order: Sequence[str], n: int, start: int = 0) -> DataFrame:
    """Adds `stop`, the place of each of the n rows by the order's columns, from `start`; checkpointed.

    Few rows are put in order in one task. More are dealt by ranges and numbered
    within each, after the number of rows of the ranges before.
    """
    if n <= ROWS_IN_A_TASK:
        return df.withColumn("stop", (F.row_number().over(Window.orderBy(*order)) - 1 + start).cast("long")).checkpoint()
    dealt = df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()).checkpoint()
    sizes = dealt.groupBy("range_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    rows = dealt.join(F.broadcast(sizes.select("range_", before.alias("before_"))), "range_")
    place = F.row_number().over(Window.partitionBy("range_").orderBy(*order)) + F.col("before_") - 1 + start
    return rows.withColumn("stop", place.cast("long")).drop("range_", "before_").checkpoint()


def tour(file_edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Reading order of files: stop, file_path, in_degree.

    Entry points, which nothing imports, come first, by name; a file follows
    once all its importers have been read, in the order in which its last
    importer was, then by name. What is left lies in or behind cycles and comes
    last, by name. Levels are peeled by joins, one a round, and each round is
    checkpointed; a self-import counts for nothing.
    """
    edges = file_edges.where("importer <> imported").select("importer", "imported").distinct().checkpoint()
    files = file_edges.select(F.col("importer").alias("file_path")).unionByName(file_edges.select(F.col("imported").alias("file_path"))).distinct()
    waiting = files.join(edges.groupBy("imported").agg(F.count(F.lit(1)).alias("left")).withColumnRenamed("imported", "file_path"), "file_path", "left").select("file_path", F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("left", F.lit(0)).alias("in_degree"), F.lit(-1).cast("long").alias("after")).checkpoint()
    done, placed = None, 0
    while True:
        ready = waiting.where("left = 0")
        n = ready.count()
        if not n:
            break
        ready = numbered(ready, ["after", "file_path"], n, placed + 1).select("file_path", "stop", "in_degree")
        done = ready if done is None else done.unionByName(ready)
        placed += n
        read = edges.join(ready, F.col("importer") == F.col("file_path")).groupBy("imported").agg(F.count(F.lit(1)).alias("read_"), F.max("stop").alias("last_")).withColumnRenamed("imported", "file_path")
        waiting = waiting.where("left > 0").join(read, "file_path", "left").select("file_path", (F.col("left") - F.coalesce("read_", F.lit(0))).alias("left"), "in_degree", F.greatest("after", F.coalesce("last_", F.lit(-1))).alias("after")).checkpoint()
    rest = numbered(waiting, ["file_path"], waiting.count(), placed + 1).select("file_path", "stop", "in_degree")
    out = rest if done is None else done.unionByName(rest)
    out = out.select("stop", "file_path", "in_degree")
    return out.where(F.col("stop") <= limit) if limit else out


def tour_notes(stops: DataFrame, file_edges: DataFrame) -> DataFrame:
    """Adds imports_from, imported_by (sorted) and the reason of each stop."""
    out = file_edges.groupBy(F.col("importer").alias("file_path")).agg(F.sort_array(F.collect_set("imported")).alias("imports_from"))
    back = file_edges.groupBy(F.col("imported").alias("file_path")).agg(F.sort_array(F.collect_set("importer")).alias("imported_by"))
    rows = stops.join(out, "file_path", "left").join(back, "file_path", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("imports_from", "imported_by")})
    n_in, n_out = F.size("imported_by"), F.size("imports_from")
    some = F.array_join(F.slice("imports_from", 1, 3), ", ")
    reason = (
        F.when((n_in == 0) & (n_out == 0), F.lit("Standalone file"))
        .when(n_in == 0, F.concat(F.lit("Entry point; imports "), some))
        .when(n_out == 0, F.concat(F.lit("Imported by "), n_in.cast("string"), F.when(n_in == 1, F.lit(" file")).otherwise(F.lit(" files"))))
        .otherwise(F.concat(F.lit("Depends on "), some))
    )
    return rows.withColumn("reason", reason)


def candidates(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls (source_id, target_name, rel_type, confidence) with every symbol of that name and their number."""
    named = symbols.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"), "file_path")
    degree = symbols.groupBy(F.col("name").alias("target_name")).agg(F.count(F.lit(1)).alias("n_candidates"))
    return calls.join(degree, "target_name").join(named, "target_name")


#: So many keys are broadcast.
FEW = 200_000


def among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose columns of the keys' names are among the keys; rows aren't shuffled for a few different keys, which are written."""
    keys = keys.distinct().checkpoint()
    return rows.join(F.broadcast(keys) if keys.count() <= FEW else keys, keys.columns, "left_semi")


def resolved(calls: DataFrame, symbols: DataFrame, files: bool = False) -> DataFrame:
    """Edges of named targets, by type; on demand with the files of both ends: importer, a column of the calls, and imported.

    Calls and uses of types go to all candidates and share their confidence;
    references go to the only candidate at 0.8 of it, else nowhere; definitions
    and inheritance go to the first candidate by file and id.
    """
    rows, kept = candidates(calls, symbols), ("importer", F.col("file_path").alias("imported")) if files else ()
    fan = rows.where(F.col("rel_type").isin("calls", "uses_type")).select("source_id", "target_id", "rel_type", (F.col("confidence") / F.col("n_candidates")).alias("confidence"), *kept)
    only = rows.where((F.col("rel_type") == "references") & (F.col("n_candidates") == 1)).select("source_id", "target_id", "rel_type", (F.col("confidence") * 0.8).alias("confidence"), *kept)
    best = F.min(F.struct("file_path", "target_id"))
    first = rows.where(F.col("rel_type").isin("defines", "inherits")).groupBy("source_id", "target_name", "rel_type", *kept[:1]).agg(best.alias("best"), F.first("confidence").alias("confidence")).select("source_id", "best.target_id", "rel_type", "confidence", *kept[:1], "best.file_path")
    first = first.withColumnRenamed("file_path", "imported") if files else first.drop("file_path")
    return fan.unionByName(only).unionByName(first)


def derived_imports(edges: DataFrame, symbols: DataFrame, known: DataFrame) -> DataFrame:
    """Imports (confidence 0.6) between files whose symbols call, inherit from or use each other, unless known."""
    at = symbols.select("id", "file_path")
    rows = edges.where(F.col("rel_type").isin("inherits", "calls", "uses_type"))
    rows = rows.join(at.select(F.col("id").alias("source_id"), F.col("file_path").alias("importer")), "source_id").join(at.select(F.col("id").alias("target_id"), F.col("file_path").alias("imported")), "target_id")
    pairs = rows.where("importer <> imported").select("importer", "imported").distinct()
    return pairs.join(known.select("importer", "imported"), ["importer", "imported"], "left_anti").withColumn("confidence", F.lit(0.6))


def suffix_matched(imports: DataFrame, files: DataFrame) -> DataFrame:
    """The file whose path ends with each imported path, on a folder boundary: module, file_path, the shortest then first.

    Every file is listed under each of its path suffixes, which turns the match
    into an equi-join.
    """
    parts = F.split("file_path", "/")
    keyed = files.select("file_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("module"))
    hits = imports.select("module").distinct().join(keyed, "module")
    return hits.groupBy("module").agg(F.min(F.struct(F.length("file_path").alias("n"), "file_path")).alias("best")).select("module", "best.file_path")


#: What may follow an import's path in a file's, in order of preference.
VARIANTS = ("", ".py", "/__init__.py", ".ts", ".tsx", "/index.ts", "/index.tsx", ".js", "/index.js", ".rs", "/mod.rs", ".go", ".rb", ".java", ".kt", ".kts")


def walked(path: Column) -> Column:
    """A path without empty, `.` and `..` segments; `..` above the top is dropped."""
    return F.aggregate(F.split(path, "/"), F.lit(""), lambda a, x: F.when(x == "..", F.regexp_replace(a, "/?[^/]*$", "")).when(x.isin(".", ""), a).when(a == "", x).otherwise(F.concat(a, F.lit("/"), x)))


def resolved_imports(imports: DataFrame, files: DataFrame, few: bool = False) -> DataFrame:
    """The file that each import (importer, module, dots) means: importer, module, imported, how; none without a file.

    A module that begins with `./` or `../`, or has leading dots (counted apart,
    one for the importer's own folder), is looked for from the importer's
    folder: under the first of the VARIANTS, else as the file with the shortest
    path right in that folder. Others match the file, without its ending or
    index name, that ends with the module's path, or with its path after the
    first segment; the shortest, then the first by name. All matches are
    equi-joins: each file is listed under its variants, folders and suffixes.
    With `few`, the keys that are asked for are found first and listed alone;
    that needs a checkpoint folder.
    """
    path = F.regexp_replace("module", r"\.", "/")
    local = F.when(F.col("dots") > 0, F.concat(F.expr("repeat('../', dots - 1)"), path)).when(F.col("module").rlike(r"^\.\.?/"), F.col("module"))
    rows = imports.withColumn("local_", local)
    stems = rows.where("local_ is not null").select("importer", "module", "dots", walked(F.concat(F.regexp_replace("importer", "[^/]*$", ""), "local_")).alias("stem"))
    tries = stems.select("*", F.posexplode(F.array(*map(F.lit, VARIANTS))).alias("k", "variant")).withColumn("file_path", F.concat("stem", "variant"))
    listed = files.select("file_path").distinct()
    best = tries.join(among(listed, tries.select("file_path")) if few else listed, "file_path").groupBy("importer", "module", "dots").agg(F.min_by("file_path", "k").alias("imported"))
    shortest = F.min(F.struct(F.length("file_path").alias("n"), "file_path"))
    folders = files.where(F.col("file_path").contains("/")).select(F.regexp_extract("file_path", "^(.*)/[^/]*$", 1).alias("stem"), "file_path")
    folders = (among(folders, stems.select("stem")) if few else folders).groupBy("stem").agg(shortest.alias("first"))
    found = stems.join(best, ["importer", "module", "dots"], "left").join(folders, "stem", "left").select("importer", "module", F.coalesce("imported", "first.file_path").alias("imported")).where("imported is not null")
    named = files.select("file_path", F.regexp_replace(F.regexp_replace("file_path", r"\.[^./]*$", ""), "/(index|__init__|mod)$", "").alias("stem"))
    parts = F.split("stem", "/")
    keyed = named.select("file_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("key"))
    far = rows.where("local_ is null").select("importer", "module", "dots", F.posexplode(F.array(path, F.regexp_replace(path, "^[^/]*/", ""))).alias("part", "key"))
    keyed = (among(keyed, far.select("key")) if few else keyed).groupBy("key").agg(shortest.alias("first"))
    far = far.join(keyed, "key").groupBy("importer", "module", "dots").agg(F.min(F.struct("part", "first")).alias("hit")).select("importer", "module", F.col("hit.first.file_path").alias("imported"))
    return found.withColumn("how", F.lit("relative")).unionByName(far.withColumn("how", F.lit("absolute")))


def prefix_matched(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """The project whose root is the longest path prefix of each path: path, project.

    Every path is listed under each of its folders, which turns the match into
    an equi-join on the root.
    """
    parts = F.split("path", "/")
    keyed = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("root"))
    hits = keyed.join(projects, "root").groupBy("path").agg(F.max_by("project", F.struct(F.length("root"), "root")).alias("project"))
    return paths.select("path").distinct().join(hits, "path", "left")


def enclosing(points: DataFrame, spans: DataFrame, key: Sequence[str]) -> DataFrame:
    """The innermost span (start_line, end_line, name) of the same key that holds each point (line); lines are 32-bit.

    Of several, the shortest, then the first by start and name. Spans may
    overlap. A span is cut into blocks of 2^l lines at multiples of 2^l, two of
    a length at most, and each block keeps its best span; a point is in one
    block of each length. So both meet in equi-joins, and the rows grow with
    the spans and the points times the logarithm of a span's length, not with
    the pairs that they make.
    """
    key = list(key)
    lo, hi = F.col("start_line").cast("long"), F.col("end_line").cast("long")
    rows = spans.where("start_line <= end_line").groupBy(*key, "start_line", "end_line").agg(F.min(F.struct("name"))["name"].alias("name"))
    longest = spans.where("start_line <= end_line").agg(F.max(hi - lo + 1)).first()[0] or 1
    levels = F.explode(F.sequence(F.lit(0), F.lit(int(longest).bit_length() - 1))).alias("level_")
    down = lambda n: F.call_function("shiftright", n, F.col("level_"))
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level_"))
    first, last = down(lo + size - 1), down(hi + 1) - 1  # the whole blocks of this length
    edges = F.array_compact(F.array(F.when((first <= last) & (first % 2 != 0), first), F.when((first <= last) & (last % 2 == 0), last)))
    blocks = rows.select(*key, "start_line", "end_line", levels).select(*key, "level_", (hi - lo).alias("size_"), lo.alias("start_"), F.explode(edges).alias("block_"))
    # Of a block, the first start of each size, by hashing; few sizes are left to be put in order.
    held = points.select(*key, "line").distinct().select(*key, "line", levels).withColumn("block_", down(F.col("line").cast("long")))
    at = [*key, "level_", "block_"]
    least = blocks.groupBy(*at, "size_").agg(F.min("start_").alias("start_"))
    order = F.struct("size_", "start_")
    least = least.groupBy(*at).agg(F.min(order).alias("best_"))
    found = held.join(least, at).groupBy(*key, "line").agg(F.min("best_").alias("best_"))
    found = found.select(*key, "line", F.col("best_.start_").alias("start_"), (F.col("best_.start_") + F.col("best_.size_")).alias("end_"))
    named = rows.select(*key, lo.alias("start_"), hi.alias("end_"), "name")
    return found.join(named, [*key, "start_", "end_"]).select(*key, "line", "name")


def layered(symbols: DataFrame) -> DataFrame:
    """Symbols with the layer of their file."""
    return symbols.withColumn("layer", layer(F.col("file_path")))
