"""Language front ends: symbols and relationships from source text, as Spark expressions.

A language is a table of line patterns. Files are scanned first: comments and
strings are masked, and brackets closed on their line. Then they become lines,
which are matched by the patterns, and nesting follows from indentation, for
languages of indented blocks, or from a running count of braces. A file's lines
stay in one task, so names are looked up within their file without a shuffle.
Several queries of the same lines should store them first.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from loomgraph.functions.lexer import prepared
from loomgraph.functions.text import constant_path
from loomgraph.session import send_package

#: Types after a colon or an arrow, and members of the own object that are neither called nor written.
ANNOTATED = r"(?:(?<!:):(?!:)|->)\s*&?(?:mut\s+)?(?:[\w.]+\.)?([A-Z]\w*)"
READS = r"\b(?:self|this)\.([A-Za-z_]\w*)\b(?!\s*\()(?!\s*(?:[-+*/|&^%]|\|\||&&|\*\*|//)?=(?!=))"
#: Variables with their types after a colon, or made by a constructor.
DECLARED = r"\b([A-Za-z_]\w*)\s*(?::\s*&?(?:mut\s+)?|(?::\s*[\w.]+\s*)?=\s*(?:new\s+)?(?=(?:[\w.]+\.)?[A-Z]\w*\s*(?:\(|::|\{)))(?:[\w.]+\.)?([A-Z]\w*)"
#: A member of a variable: its name, the member, a bracket if it is called; not one that is written.
MEMBERS = r"(?<![\w.$])([A-Za-z_]\w*)\.([A-Za-z_]\w*)\b(?!\s*(?:[-+*/|&^%]|\|\||&&|\*\*|//)?=(?!=))(\s*\()?"
#: What a line defines, for the nesting.
CLASS, BLOCK, FUNCTION = 1, 2, 3
#: A pattern that matches no line.
NOTHING = r"(?!)()"


class Language(NamedTuple):
    """Patterns (group 1 is the name) of one language."""

    classes: str
    functions: str
    imports: str
    inherits: str  # group 1: bases, comma-separated
    fields: str
    comment: str
    indented: bool
    methods: str = NOTHING
    names: str = NOTHING  # group 1: what an import brings in, identifiers in any punctuation
    types: str = NOTHING  # every match's group 1 is a type that the line uses
    reads: str = NOTHING  # every match's group 1 is a member that the line reads
    owners: str = NOTHING  # a block that holds methods of group 1, but is no symbol
    receiver: str = NOTHING  # the class of a method that stands outside it
    variables: str = NOTHING  # every match's groups 1 and 2 are a variable and its declared type
    typed: str = NOTHING  # the same with the type first
    joint: str = ""  # between class and method in a method's name; empty for bare names


#: File extensions by language.
EXTENSIONS = {"py": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "mjs": "javascript", "cjs": "javascript", "rs": "rust", "go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin", "rb": "ruby"}
#: Words that look like calls but aren't.
NOT_CALLS = ("if", "for", "while", "switch", "catch", "return", "def", "class", "fn", "func", "fun", "function", "match", "when", "super", "new", "elif", "else", "and", "or", "not", "in", "with", "print", "assert", "sizeof", "typeof", "lambda", "import", "yield", "await", "async", "require", "puts", "throw", "raise", "constructor")

_TS = Language(
    r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:class|interface|type|enum)\s+([A-Za-z_$][\w$]*)",
    r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s*\*?\s*|(?:const|let|var)\s+(?=[\w$]+\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|[A-Za-z_$][\w$]*\s*=>)))([A-Za-z_$][\w$]*)",
    r"^\s*(?:import|export)\b[^'\"]*['\"]([^'\"]+)['\"]",
    r"\b(?:extends|implements)\s+([\w$.,\s]+?)\s*\{",
    r"^\s+(?:public\s+|private\s+|protected\s+|readonly\s+|static\s+)*([A-Za-z_$][\w$]*)\s*[?!]?\s*(?::[^=(){}]+)?(?:=[^>].*)?;\s*$",
    r"^\s*(?://|\*|/\*)",
    False,
    r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+|get\s+|set\s+)*([A-Za-z_$][\w$]*)\s*\([^)]*\)\s*(?::[^={]+)?\{",
    r"^\s*import\s+(?:type\s+)?([^'\"]*?)\s+from\b",
    ANNOTATED,
    READS,
    variables=DECLARED,
)

LANGUAGES: dict[str, Language] = {
    "python": Language(r"^\s*class\s+([A-Za-z_]\w*)", r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)", r"^\s*(?:from|import)\s+([.\w]+)", r"^\s*class\s+[A-Za-z_]\w*\s*\(([^)]*)\)", r"^\s+([A-Za-z_]\w*)\s*(?::\s*[^=]+)?(?:=(?!=).*)?$", r"^\s*#", True, names=r"^\s*(?:from\s+[.\w]+\s+)?import\s+([\w, ()*]+)", types=ANNOTATED, reads=READS, variables=DECLARED),
    "typescript": _TS, "tsx": _TS, "javascript": _TS, "jsx": _TS,
    "rust": Language(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+([A-Za-z_]\w*)", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+([A-Za-z_]\w*)", r"^\s*(?:pub\s+)?use\s+([\w:]+)", r"^\s*impl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\s+\w+", r"^\s+(?:pub(?:\([^)]*\))?\s+)?([a-z_]\w*)\s*:\s*[^:=][^=]*,\s*$", r"^\s*//", False, names=r"^\s*(?:pub\s+)?use\s+(?:\w+::)*(\w+|\{[^}]*\})", types=ANNOTATED, reads=READS, owners=r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:]+(?:<[^>]*>)?\s+for\s+)?(\w+)", variables=DECLARED, joint="::"),
    "go": Language(r"^\s*type\s+([A-Za-z_]\w*)\s+(?:struct|interface)\b", r"^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", r"^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\"\s*$", r"^\s+\*?([A-Z]\w*)\s*$", r"^\s+([A-Za-z_]\w*)\s+[\[\]*\w.]+(?:\s+`[^`]*`)?\s*$", r"^\s*//", False, types=r"^\s*(?:func\b|var\b|\w+\s).*?[\s(\]*](?:[a-z]\w*\.)?([A-Z]\w*)(?=\s*[,){]|\s*$)", receiver=r"^\s*func\s+\(\s*(?:\w+\s+)?\*?(\w+)", variables=r"\b(\w+)\s*(?:\s(?:\.\.\.|\[\])?|:=\s*&?)\*?(?:[a-z]\w*\.)?([A-Z]\w*)(?=\s*[,){=]|\s*$)"),
    "java": Language(r"^\s*(?:[a-z]+\s+)*(?:class|interface|enum|record|@interface)\s+([A-Za-z_]\w*)", NOTHING, r"^\s*import\s+(?:static\s+)?([\w.]+)", r"\b(?:extends|implements)\s+([\w.,\s<>]+?)\s*\{", r"^\s+(?:[a-z]+\s+)*[A-Za-z_][\w<>\[\], ]*\s+([A-Za-z_]\w*)\s*(?:=[^=].*)?;\s*$", r"^\s*(?://|\*|/\*)", False, r"^\s+(?=.*\{|(?!(?:return|throw|new|else|case|assert|yield)\b)(?:[a-z]+\s+)*[A-Za-z_][\w<>\[\], .]*\s[A-Za-z_]\w*\s*\([^)]*\)[^=]*;\s*$)(?:public\s+|private\s+|protected\s+|static\s+|final\s+|abstract\s+|synchronized\s+)*(?:[A-Za-z_][\w<>\[\], .]*\s+)?([A-Za-z_]\w*)\s*\([^)]*\)\s*(?:throws\s+[\w, .]+)?[{;]", r"^\s*import\s+(?:static\s+)?(?:\w+\.)*(\w+)\s*;", r"\b([A-Z]\w*)(?:<[^>]*>)?(?:\[\])*\s+[a-z_]\w*\s*[=;,)]", READS, typed=r"\b([A-Z]\w*)(?:<[^>]*>)?\s+([a-z_]\w*)\s*[=;,)]"),
    "kotlin": Language(r"^\s*(?:[a-z]+\s+)*(?:class|interface|object)\s+([A-Za-z_]\w*)", r"^\s*(?:[a-z]+\s+)*fun\s+(?:<[^>]*>\s*)?(?:[A-Za-z_]\w*\.)?([A-Za-z_]\w*)", r"^\s*import\s+([\w.]+)", r"\b(?:class|object|interface)\s+\w+(?:<[^>]*>)?\s*(?:\([^)]*\))?\s*:\s*([\w.,\s()]+?)\s*(?:\{|$)", r"^\s+(?:[a-z]+\s+)*va[lr]\s+([A-Za-z_]\w*)", r"^\s*(?://|\*|/\*)", False, names=r"^\s*import\s+(?:\w+\.)*(\w+(?:\s+as\s+\w+)?)\s*$", types=ANNOTATED, reads=READS, variables=DECLARED),
    "ruby": Language(r"^\s*(?:class|module)\s+([A-Z]\w*(?:::\w+)*)", r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)", r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]", r"^\s*(?:class\s+[\w:]+\s*<|include|prepend|extend)\s*(?:::)?([A-Z][\w:]*(?:\s*,\s*(?:::)?[A-Z][\w:]*)*)", r"^\s*attr_(?:reader|writer|accessor)\s+:(\w+)", r"^\s*#", True),
}


def _with_patterns(rows: DataFrame) -> DataFrame:
    """Rows with the patterns of their language as columns; the table of patterns has a row per language."""
    spark = rows.sparkSession
    table = [(name, *(language.indented if f == "indented" else getattr(language, f) for f in Language._fields)) for name, language in LANGUAGES.items()]
    kinds = ", ".join(f"p_{f} {'boolean' if f == 'indented' else 'string'}" for f in Language._fields)
    return rows.join(F.broadcast(spark.createDataFrame(table, f"language string, {kinds}")), "language")


def patterned(lines: DataFrame) -> DataFrame:
    """Lines with the patterns of their language as columns."""
    return _with_patterns(lines)


def _named(pattern: str) -> Column:
    return F.nullif(F.expr(f"regexp_extract(line, p_{pattern}, 1)"), F.lit(""))


def _all(pattern: str) -> Column:
    """Group 1 of every match of a pattern, each once."""
    return F.array_distinct(F.expr(f"regexp_extract_all(line, p_{pattern}, 1)"))


def language_of(path: Column) -> Column:
    """Language by the file's extension, null if unknown."""
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return known[F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))]


#: What is known of a line's place: depth of braces before it, where its definition ends, the file's last line, and which definitions hold it.
_PLACE = pa.struct([("depth", pa.int32()), ("end", pa.int32()), ("last", pa.int32()), ("owner_kind", pa.int32()), ("owner", pa.string()), ("inside_at", pa.int32()), ("inside", pa.string()), ("inside_receiver", pa.string()), ("inside_owner_kind", pa.int32()), ("inside_owner", pa.string()), ("held", pa.string())])


def _places(at: list, indents: list, braces: list, kinds: list, stops: list, indented: list) -> list[list]:
    """For each line of whole files: depth, end, last line, and the rows of the definition that holds it, of the innermost function and of the class; -1 is none."""
    n = len(at)
    depths, ends, lasts, owners, insides, helds = [0] * n, [-1] * n, [0] * n, [-1] * n, [-1] * n, [-1] * n
    open_, first, depth, last = [], 0, 0, 0

    def close(end: int) -> None:
        for _, row, _, _ in open_:
            ends[row] = last
        lasts[first:end] = [last] * (end - first)

    for i in range(n):
        if at[i] == 0:
            close(i)
            open_, first, depth, last = [], i, 0, 0
        level, stop = indents[i] if indented[i] else depth, stops[i]
        depths[i] = depth
        if stop:
            last = at[i] + 1
            if stop == 2:
                while open_ and open_[-1][0] >= level:
                    ends[open_.pop()[1]] = at[i]
        inside = held = -1
        if open_:
            _, owners[i], inside, held = open_[-1]
        what = kinds[i]
        if what:
            inside, held = i if what == FUNCTION else inside, i if what == CLASS else held
            open_.append((level, i, inside, held))
        insides[i], helds[i] = inside, held
        depth += braces[i]
    close(n)
    return [depths, ends, lasts, owners, insides, helds]


def _nested(rows: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """The place of each line of files, whose lines follow one another, numbered from 0; a file whose lines are cut by a batch waits for the rest.

    A line that stops definitions (2) ends the open ones that aren't less deep
    than it; what is open then holds it.
    """

    def placed(columns: list[pa.Array]) -> pa.Array:
        at, _, _, kinds, _, _, names, receivers = columns
        depth, end, last, owner, inside, held = _places(*(c.to_pylist() for c in columns[:6]))
        row = lambda x: pc.if_else(pc.less(pa.array(x, pa.int32()), 0), None, pa.array(x, pa.int32()))
        owner, inside, held = row(owner), row(inside), row(held)
        owner_kind, owner_name = kinds.take(owner), names.take(owner)
        found = [pa.array(depth, pa.int32()), pa.array(end, pa.int32()), pa.array(last, pa.int32()), owner_kind, owner_name, at.take(inside), names.take(inside), receivers.take(inside), owner_kind.take(inside), owner_name.take(inside), names.take(held)]
        return pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(found, _PLACE, strict=True)], fields=list(_PLACE))

    waiting: list[list[pa.Array]] = []
    for batch in rows:
        starts = pc.indices_nonzero(pc.equal(batch[0], 0))
        cut = starts[-1].as_py() if len(starts) else 0
        if cut or (waiting and len(starts)):
            whole = [*waiting, [c.slice(0, cut) for c in batch]]
            waiting = [[c.slice(cut) for c in batch]]
            yield placed([pa.concat_arrays(parts) for parts in zip(*whole, strict=True)])
        else:
            waiting.append(list(batch))
    if waiting:
        yield placed([pa.concat_arrays(parts) for parts in zip(*waiting, strict=True)])


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def lines_of(files: DataFrame) -> DataFrame:
    """One row per line that isn't blank or a comment: file_path, language, line_no (from 1), line, indent, depth (of braces before the line), and how lines nest.

    A definition ends before the next line that isn't deeper, or at the end of
    the file. For a line that defines something: symbol_, kind_ (class, block,
    function or method), end_line and parent_; for a field's line: field_ and
    holder_, its class. inside_ is the innermost function that holds the line,
    class_ the name of the innermost class, last_line the file's last line.

    All this follows from the file alone: lines are matched one by one, in the
    order of their file, and a pass over them tells what holds each. Before it,
    files are dealt to as many tasks as shuffles have, as few bytes of a table
    may make much text; a file's lines stay in its task. The files of a task
    are ordered by language, so that each pattern is compiled once.
    """
    spark = files.sparkSession
    send_package(spark)
    known = files.repartition(_tasks(spark), "file_path").select("file_path", language_of(F.col("file_path")).alias("language"), F.coalesce("content", F.lit("")).alias("content")).where("language is not null").sortWithinPartitions("language")
    rows = _with_patterns(known.select("file_path", "language", F.posexplode(F.split(prepared(F.col("content"), F.col("language")), "\r?\n")).alias("at_", "line")))
    some = lambda name: F.coalesce(F.col(name) != "", F.lit(False))
    code = (F.trim("line") != "") & ~F.expr("rlike(line, p_comment)")
    found = {f"r_{name}": F.when(F.col("code_"), F.expr(f"regexp_extract(line, p_{name}, 1)")) for name in ("classes", "owners", "functions", "methods", "fields", "receiver")}
    rows = rows.select("file_path", "language", "at_", "line", code.alias("code_"), *(f"p_{f}" for f in ("classes", "owners", "functions", "methods", "fields", "receiver", "indented", "joint")))
    rows = rows.select("file_path", "language", "at_", "line", "code_", "p_indented", "p_joint", *(c.alias(name) for name, c in found.items()))
    method = some("r_methods") & ~F.col("r_methods").isin(*NOT_CALLS)
    what = F.when(some("r_classes"), CLASS).when(some("r_owners"), BLOCK).when(some("r_functions") | method, FUNCTION).otherwise(0)
    name = F.when(some("r_classes"), F.col("r_classes")).when(some("r_owners"), F.col("r_owners")).when(some("r_functions"), F.col("r_functions")).when(method, F.col("r_methods"))
    count = lambda sign: F.length("line") - F.length(F.replace("line", F.lit(sign), F.lit("")))
    rows = rows.select("file_path", "language", "at_", "line", "code_", "p_indented", "p_joint", (F.length("line") - F.length(F.ltrim("line"))).alias("indent"), (count("{") - count("}")).alias("braces_"), what.alias("what_"), name.alias("name_"), F.nullif("r_receiver", F.lit("")).alias("receiver_"), F.nullif("r_owners", F.lit("")).alias("block_"), F.when(some("r_fields"), F.col("r_fields")).alias("r_fields"))
    closes = F.trim("line").rlike(r"^([)}\]]|end\b)")
    stop = F.when(~F.col("code_"), 0).when((F.col("what_") == 0) & closes, 1).otherwise(2)
    kinds = "struct<depth:int,end:int,last:int,owner_kind:int,owner:string,inside_at:int,inside:string,inside_receiver:string,inside_owner_kind:int,inside_owner:string,held:string>"
    place = F.arrow_udf(kinds)(_nested).asNondeterministic()  # it needs all lines, so no filter may be moved before it
    rows = rows.withColumn("nest", place("at_", "indent", "braces_", "what_", stop, "p_indented", "name_", "receiver_")).where("code_")
    nest, kind = F.col("nest"), F.col("what_")
    # A method's class: the receiver that it names, else what holds it.
    of = lambda receiver, owner_kind, owner: F.coalesce(receiver, F.when(owner_kind.isin(CLASS, BLOCK), owner))
    full = lambda of, name: F.when(of.isNotNull() & (F.col("p_joint") != ""), F.concat(of, "p_joint", name)).otherwise(name)
    own_of = of(F.col("receiver_"), nest["owner_kind"], nest["owner"])
    inside_of = of(nest["inside_receiver"], nest["inside_owner_kind"], nest["inside_owner"])
    is_method = (kind == FUNCTION) & own_of.isNotNull()
    said = F.when(is_method, "method").when(kind == FUNCTION, "function").when(kind == CLASS, "class").when(kind == BLOCK, "block")
    is_field = F.col("r_fields").isNotNull() & (kind == 0) & (nest["owner_kind"] == CLASS) & ~F.col("r_fields").isin(*NOT_CALLS, "pass", "self", "end")
    return rows.select(
        "file_path", "language", (F.col("at_") + 1).alias("line_no"), "line", "indent", nest["depth"].alias("depth"), nest["last"].alias("last_line"),
        F.when(kind == FUNCTION, full(own_of, F.col("name_"))).otherwise(F.col("name_")).alias("symbol_"), said.alias("kind_"), nest["end"].alias("end_line"), F.coalesce("receiver_", nest["owner"]).alias("parent_"),
        F.when(is_field, F.col("r_fields")).alias("field_"), F.when(is_field, nest["owner"]).alias("holder_"),
        F.struct(full(inside_of, nest["inside"]).alias("name"), (nest["inside_at"] + 1).alias("start_line"), F.coalesce(nest["inside_receiver"], nest["inside_owner"]).alias("parent")).alias("inside_"),
        nest["held"].alias("class_"), "block_",
    )


def parsed_symbols(lines: DataFrame) -> DataFrame:
    """Symbols: file_path, language, name, kind, start_line, end_line, parent.

    A file is a symbol that spans it. A function whose innermost enclosing
    definition is a class, or that names a receiver, is a method. In languages
    with a joint, a method's name begins with that of its class. Fields are
    looked for directly in classes.
    """
    one = lambda name, kind, start, end, parent: F.struct(F.col(name).alias("name"), kind.alias("kind"), start.cast("int").alias("start_line"), F.col(end).cast("int").alias("end_line"), parent.cast("string").alias("parent"))
    at = F.col("line_no")
    found = F.array(
        F.when(at == F.col("last_line"), one("file_path", F.lit("file"), F.lit(1), "last_line", F.lit(None))),
        F.when(F.col("kind_") != "block", one("symbol_", F.col("kind_"), at, "end_line", F.col("parent_"))),
        F.when(F.col("field_").isNotNull(), one("field_", F.lit("field"), at, "line_no", F.col("holder_"))),
    )
    return lines.select("file_path", "language", F.explode(F.array_compact(found)).alias("s")).select("file_path", "language", "s.*")


def autoloads(lines: DataFrame) -> DataFrame:
    """What Ruby files name without requiring it, superclasses and included modules: file_path, constant, module (the path it is loaded from)."""
    code = patterned(lines.where("language = 'ruby'")).select("file_path", F.explode(F.split(_named("inherits"), r"\s*,\s*")).alias("constant")).distinct()
    return code.withColumn("module", constant_path(F.col("constant")))


#: What a row of `facts` tells: a symbol, an edge by name, an import, or a member used on a variable of a type that the file doesn't define it for.
SYMBOL, EDGE, IMPORT, TYPED = 1, 2, 3, 4
#: What is looked up on the way there: names that are imported, edges whose confidence isn't known yet, types of variables, members of types.
_BROUGHT, _USED, _DECLARED, _MEMBER, _LOADED = 5, 6, 7, 8, 9
#: Kinds of symbols, by their number in a place.
KINDS = ("file", "class", "function", "method", "field")
_CALL = r"(?<![\w$:])((?:self\.|this\.|Self::)?[A-Za-z_$][\w$]*(?:::[a-z_]\w*)?)\s*\("
_OWN = r"^(self\.|this\.|Self::)"


def place(line: Column, kind: Column) -> Column:
    """A symbol's line and kind in one number, in the order of lines."""
    return line.cast("long") * 8 + F.array_position(F.array(*map(F.lit, KINDS)), kind) - 1


def placed(place_: Column) -> tuple[Column, Column]:
    """The line and the kind of a place."""
    return F.call_function("shiftright", place_, F.lit(3)).cast("int"), F.array(*map(F.lit, KINDS))[(place_ % 8).cast("int")]


def symbol_id(path: Column, kind: Column, name: Column, line: Column) -> Column:
    return F.md5(F.concat_ws("\n", path, kind, name, line))


def _stated(lines: DataFrame) -> DataFrame:
    """What each line states by itself: file_path, language, fact, name, source, rel_type, confidence, kind, at_ (a line), end_line, parent."""
    code = patterned(lines).withColumns({"module_": _named("imports"), "names_": F.coalesce(_named("names"), F.lit("")), "inherits_": _named("inherits")})
    fields = {"fact": "int", "name": "string", "source": "string", "rel_type": "string", "confidence": "double", "kind": "string", "at_": "int", "end_line": "int", "parent": "string", "own_": "boolean"}
    path, line = F.col("file_path"), F.col("line")
    is_import, within = F.col("module_").isNotNull(), F.col("inside_.start_line").isNotNull()

    def fact(code: int, **values: Column) -> Column:
        return F.struct(F.lit(code).alias("fact"), *(values.get(f, F.lit(None)).cast(kind).alias(f) for f, kind in fields.items() if f != "fact"))

    def every(array: Column, where: Column, change) -> Column:
        return F.when(where, F.transform(array, change))

    bases = F.split(F.regexp_replace("inherits_", r"\([^)]*\)", ""), r"\s*,\s*|\s+implements\s+")
    bases = F.filter(F.transform(bases, lambda b: F.regexp_extract(b, r"^\s*([\w$.:]+)", 1)), lambda b: ~b.isin("", "object"))
    code = code.withColumn("bases_", F.when(F.col("inherits_").isNotNull(), bases))
    words = lambda pattern: F.regexp_extract_all("names_", F.lit(pattern), F.lit(1))
    both = lambda p, a, b: F.arrays_zip(F.expr(f"regexp_extract_all(line, p_{p}, {a})").alias("v"), F.expr(f"regexp_extract_all(line, p_{p}, {b})").alias("t"))
    declared = lambda x: fact(_DECLARED, name=x["v"], at_=F.col("inside_.start_line"), parent=x["t"])
    user = F.coalesce("inside_.name", path)
    use = lambda kind, own: lambda c: fact(_USED, name=c, source=user, rel_type=F.lit(kind), confidence=F.lit(0.6 if own else 0.5), own_=F.lit(own))
    called = lambda c: fact(_USED, name=F.regexp_replace(c, _OWN, ""), source=user, rel_type=F.lit("calls"), confidence=F.when(c.rlike(_OWN), 0.6).otherwise(0.5), own_=c.rlike(_OWN))
    heir = F.coalesce("block_", "class_")
    one = F.array_compact(F.array(
        F.when(F.col("line_no") == F.col("last_line"), fact(SYMBOL, name=path, kind=F.lit("file"), at_=F.lit(1), end_line=F.col("last_line"))),
        F.when(F.col("kind_") != "block", fact(SYMBOL, name=F.col("symbol_"), kind=F.col("kind_"), at_=F.col("line_no"), end_line=F.col("end_line"), parent=F.col("parent_"))),
        F.when(F.col("field_").isNotNull(), fact(SYMBOL, name=F.col("field_"), kind=F.lit("field"), at_=F.col("line_no"), end_line=F.col("line_no"), parent=F.col("holder_"))),
        F.when(is_import, fact(IMPORT, name=F.col("module_"))),
    ))
    many = [
        every(words(r"([A-Za-z_$][\w$]*)"), is_import & (F.col("names_") != ""), lambda n: fact(_BROUGHT, name=n)),
        every(words(r"(\w+)(?:\s+as\s+\w+)?"), (F.col("language") == "python") & F.expr("rlike(line, '^ *from ')"), lambda n: fact(EDGE, name=n, source=path, rel_type=F.lit("uses_type"), confidence=F.lit(0.8))),
        every(F.col("bases_"), heir.isNotNull() & F.col("bases_").isNotNull(), lambda b: fact(_USED, name=b, source=heir, rel_type=F.lit("inherits"), confidence=F.lit(0.5))),
        every(F.split("inherits_", r"\s*,\s*"), (F.col("language") == "ruby") & F.col("inherits_").isNotNull(), lambda c: fact(_LOADED, name=c)),
        every(F.regexp_extract_all(line, F.lit(_CALL), F.lit(1)), ~is_import & line.contains("("), called),
        every(_all("types"), ~is_import & (F.col("p_types") != NOTHING), use("uses_type", False)),
        every(_all("reads"), ~is_import & (F.col("p_reads") != NOTHING) & line.contains("."), use("references", True)),
        every(both("variables", 1, 2), within & (F.col("p_variables") != NOTHING), declared),
        every(both("typed", 2, 1), within & (F.col("p_typed") != NOTHING), lambda x: declared(x)),
        every(F.filter(F.regexp_extract_all(line, F.lit(MEMBERS), F.lit(0)), lambda m: ~F.substring_index(m, ".", 1).isin("self", "this")), within & line.contains("."), lambda m: fact(TYPED, name=F.substring_index(m, ".", 1), source=F.col("inside_.name"), at_=F.col("inside_.start_line"), kind=F.regexp_replace(F.substring_index(m, ".", -1), r"\s*\($", ""), rel_type=F.when(F.endswith(m, F.lit("(")), "calls").otherwise("references"))),
    ]
    none = F.array().cast(f"array<struct<{','.join(f'{f}:{kind}' for f, kind in fields.items())}>>")
    kept = ("file_path", "language", "symbol_", "kind_", "bases_", F.col("inside_.parent").alias("within_"), F.col("p_joint").alias("joint_"))
    rows = code.select(*kept, F.explode(F.concat(one, *(F.coalesce(m, none) for m in many))).alias("f")).select("file_path", "language", "symbol_", "kind_", "bases_", "within_", "joint_", "f.*")
    # A line doesn't use what it defines or inherits from; on the own object, a name means the member of the source's class first.
    used, name = (F.col("fact") == _USED) & (F.col("rel_type") != "inherits"), F.col("name")
    defining = F.col("kind_").isin("class", "function", "method") & (F.element_at(F.split("symbol_", r"::|\."), -1) == name) & F.col("rel_type").isin("calls", "uses_type")
    no_use = name.isin(*NOT_CALLS) | F.coalesce(defining, F.lit(False)) | F.coalesce(F.array_contains("bases_", name), F.lit(False))
    rows = rows.where(~(used & no_use) & ~((F.col("fact") == _BROUGHT) & name.isin("as", "type")))
    member = used & F.col("own_") & (F.col("joint_") != "") & (F.col("rel_type") == "calls") & F.col("within_").isNotNull()
    return rows.select("file_path", "language", *(f for f in fields if f not in ("name", "own_")), F.when(member, F.concat("within_", "joint_", name)).otherwise(name).alias("name"))


def within_files(*keys: Column | str) -> WindowSpec:
    """Windows of a file's rows of equal keys. Rows are sorted by a hash first, which spares comparing long paths that begin alike."""
    return Window.partitionBy(F.xxhash64("file_path", *keys), "file_path", *keys)


def facts(lines: DataFrame) -> DataFrame:
    """What the files' lines tell, with names looked up within their file: a row per fact, repeated ones too.

    Each holds file_path, language, fact, and by its kind
    SYMBOL: name, kind, at_ (its first line), end_line, parent;
    EDGE: source, rel_type, confidence, name (null, if it repeats another edge to a member by its place), target, and target_at, the place of the first symbol of that name in the file, if there is one;
    IMPORT: name (the module), kind (statement or autoload);
    TYPED: source, rel_type, type_, member_.

    A variable's type holds within the innermost function that declares it, as
    receiver, parameter or local variable. What the lines state is dealt by file once; equal names of a file then meet
    by windows, without another shuffle.
    """
    rows, f = _stated(lines).repartition(_tasks(lines.sparkSession), "file_path"), F.col("fact")
    symbol = (f == SYMBOL) & (F.col("kind") != "file")
    variable = f.isin(_DECLARED, TYPED)
    by_name = within_files("scope_", "name")
    rows = rows.withColumn("scope_", F.when(variable, F.col("at_")).otherwise(-1)).withColumns({
        "tier_": F.max(F.when(symbol, 1.0).when(f == _BROUGHT, 0.8)).over(by_name),
        "local_": F.min(F.when(symbol, place(F.col("at_"), F.col("kind")))).over(by_name),
        "types_": F.collect_set(F.when(f == _DECLARED, F.col("parent"))).over(by_name),
    })
    kinds = {"fact": "int", "source": "string", "rel_type": "string", "confidence": "double", "type_": "string", "member_": "string"}

    def row(code: int, **values: Column) -> Column:
        return F.struct(F.lit(code).alias("fact"), *(values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items() if c != "fact"))

    same = {"source": F.col("source"), "rel_type": F.col("rel_type")}
    tail = F.element_at(F.split("name", "::"), -1)
    defines = row(EDGE, source=F.coalesce("parent", "file_path"), rel_type=F.lit("defines"), confidence=F.lit(1.0))
    held = F.when(symbol & F.col("kind").isin("field", "method") & F.col("parent").isNotNull(), row(_MEMBER, type_=F.col("parent"), member_=tail))
    seen = (F.col("rel_type") != "references") | F.coalesce(F.col("tier_") == 1.0, F.lit(False))
    told = (
        F.when(f == SYMBOL, F.array_compact(F.array(row(SYMBOL), F.when(symbol, defines), held)))
        .when((f == _USED) & seen, F.array(row(EDGE, **same, confidence=F.coalesce("tier_", "confidence"))))
        .when(f == EDGE, F.array(row(EDGE, **same, confidence=F.col("confidence"))))
        .when(f == IMPORT, F.array(row(IMPORT), row(EDGE, source=F.col("file_path"), rel_type=F.lit("imports"), confidence=F.lit(0.3))))
        .when(f == _LOADED, F.array(row(_LOADED)))
        .when(f == TYPED, F.transform("types_", lambda t: row(TYPED, **same, type_=t, member_=F.col("kind"))))
    )
    own = ("file_path", "language", "name", "kind", "at_", "end_line", "parent", "local_")
    rows = rows.select(*own, F.explode(told).alias("t")).select(*own, "t.*")
    # Members of a type that the file defines: each by its name, and the one of the least id.
    by_member = within_files("type_", F.coalesce("member_", "name"))
    to = F.struct(F.col("name").alias("name"), F.col("name").alias("target"), F.col("local_").alias("target_at"))
    least = F.struct(symbol_id(F.col("file_path"), F.col("kind"), F.col("name"), F.col("at_")).alias("id"), F.lit(None).cast("string").alias("name"), F.col("name").alias("target"), place(F.col("at_"), F.col("kind")).alias("target_at"))
    is_member = f == _MEMBER
    rows = rows.withColumns({"named_": F.collect_set(F.when(is_member, to)).over(by_member), "least_": F.min(F.when(is_member, least)).over(by_member)})
    known = (f == TYPED) & F.col("least_").isNotNull()
    itself = F.struct(F.col("name").alias("name"), F.col("name").alias("target"), F.col("local_").alias("target_at"))
    meant = F.when(known, F.concat("named_", F.array(F.struct(F.col("least_.name"), F.col("least_.target"), F.col("least_.target_at"))))).otherwise(F.array(itself))
    own = ("file_path", "language", "source", "rel_type", "kind", "at_", "end_line", "parent", "type_", "member_")
    rows = rows.where(~is_member).select(*own, F.when(known, EDGE).otherwise(f).alias("fact"), F.when(known, 1.0).otherwise(F.col("confidence")).alias("confidence"), F.explode(meant).alias("m")).select(*own, "fact", "confidence", "m.*")
    loaded = f == _LOADED
    return rows.withColumns({"name": F.when(loaded, constant_path(F.col("name"))).otherwise(F.col("name")), "kind": F.when(loaded, "autoload").when(f == IMPORT, "statement").otherwise(F.col("kind")), "fact": F.when(loaded, IMPORT).otherwise(f)})


def parsed_relationships(lines: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Relationships by name: file_path, source, target, rel_type, confidence.

    defines (1.0) from a class to its members or from the file; imports (0.3,
    until the file is found); references (1.0) to members that are read from
    the own object and defined in the file; inherits, calls and uses_type by
    where the target is known: 1.0 in the file, 0.8 where imported, 0.5
    elsewhere, 0.6 for a call on self or this. All but inheritance belong to
    the innermost enclosing function, else to the file. On the own object, a
    name means the member of the source's class first, in languages with a
    joint. What a Python file imports by name, it uses (0.8). The symbols follow
    from the lines and needn't be given.
    """
    rows = facts(lines).where((F.col("fact") == EDGE) & F.col("name").isNotNull() & (F.col("source") != F.col("name")))
    return rows.groupBy("file_path", "source", F.col("name").alias("target"), "rel_type").agg(F.max("confidence").alias("confidence"))
