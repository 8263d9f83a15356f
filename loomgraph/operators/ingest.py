"""Turning documents and pull requests into memories."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import stripped

#: Least bytes of a trimmed section and of a pull request's body.
SECTION_BYTES, BODY_BYTES = 200, 50
#: Fixed value: the pattern of a repository's name.
REPOSITORY = r"[A-Za-z0-9._-]+/[A-Za-z0-9._-]+"


def sections(files: DataFrame, text: str = "content") -> DataFrame:
    """One row per section of each markdown file: section_no, title (null for what precedes the first heading), section, n_bytes, stored.

    A section starts at a line that starts with `## `. An empty file gives no
    row; sections of fewer than 200 trimmed bytes aren't stored.
    """
    parts = F.split(F.coalesce(F.col(text), F.lit("")), r"(?m)^(?=## )")
    rows = files.select("*", F.posexplode(F.filter(parts, lambda p: p != "")).alias("section_no", "section"))
    title = F.when(F.col("section").startswith("## "), stripped(F.regexp_extract("section", r"^## ([^\n]*)", 1)))
    size = F.octet_length(stripped(F.col("section"))).cast("long")
    return rows.withColumns({"title": title, "n_bytes": size, "stored": size >= SECTION_BYTES})


def memory_type_of_stem(stem: Column) -> Column:
    """Kind of memory by a document's name."""
    s = F.lower(stem)
    return (
        F.when(s.rlike("architecture|design") | s.rlike("(-adr|-decision)$") | s.rlike("^adr[-_]"), "architecture")
        .when(s.rlike("contributing|guideline|style|conduct"), "guideline")
        .otherwise("code_context")
    )


def memory_type_of_title(title: Column) -> Column:
    """Kind of memory by a pull request's title."""
    t = F.lower(title)
    return F.when(t.contains("fix") | t.contains("bug"), "error_pattern").when(t.contains("refactor"), "pattern").otherwise("decision")


def importance_of(kind: Column) -> Column:
    """Importance of a document's memory by its kind."""
    return F.when(kind == "architecture", 0.8).when(kind == "guideline", 0.7).otherwise(0.6)


def slug(stem: Column) -> Column:
    """Tag of a document's name."""
    return F.translate(F.lower(stem), " /", "--")


def pull_requests(rows: DataFrame, body: str = "json") -> DataFrame:
    """Fields of pull requests in JSON with their defaults, and whether they are stored (50 bytes of trimmed body)."""
    schema = "number long, title string, body string, mergedAt string, author struct<login:string>, url string"
    pr = F.from_json(body, schema)
    out = rows.withColumn("pr_", pr).select("*", F.coalesce("pr_.number", F.lit(0)).alias("number"), F.coalesce("pr_.title", F.lit("")).alias("title"), F.coalesce("pr_.body", F.lit("")).alias("body"), F.coalesce("pr_.author.login", F.lit("unknown")).alias("author"), F.coalesce("pr_.url", F.lit("")).alias("url")).drop("pr_")
    return out.withColumns({"memory_type": memory_type_of_title(F.col("title")), "stored": F.octet_length(stripped(F.col("body"))) >= BODY_BYTES})


def valid_repository(name: str) -> bool:
    """Whether a repository's name is `owner/name` of letters, digits, `-`, `_` and `.`."""
    return re.fullmatch(REPOSITORY, name) is not None


def repository_project(name: Column) -> Column:
    """The project of a repository's name, its second part; null if the name isn't valid."""
    return F.when(name.rlike(rf"\A{REPOSITORY}\z"), F.substring_index(name, "/", -1))
