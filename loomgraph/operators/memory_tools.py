"""Storing, recalling and ingesting memories end to end, with the limits and defaults of a caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import ingest, memory_search
from loomgraph.views import MEMORY_TYPES

#: Default, least and greatest number of memories recalled, of an impact's hops, of a tour's stops, of pull requests.
RECALLED, HOPS, STOPS, PULLS = (10, 1, 25), (3, 1, 10), (20, 1, 100), (50, 1, 200)
#: At this similarity a stored memory may contradict a new one, and so many of these are told.
CONTRADICTION, TOLD = 0.75, 3


def clamped(value: int | None, bounds: tuple[int, int, int]) -> int:
    """The value within (default, least, greatest); the default for none."""
    default, least, greatest = bounds
    return max(least, min(greatest, default if value is None else value))


def listed(csv: str | None) -> list[str]:
    """The parts of a comma-separated list, trimmed; none for None."""
    return [] if csv is None else [part.strip() for part in csv.split(",")]


def kinds(csv: str | None) -> list[str]:
    """The kinds of memories in a comma-separated list; unknown ones are an error."""
    out = listed(csv)
    for kind in out:
        if kind not in MEMORY_TYPES:
            raise ValueError(f"invalid memory_type: {kind}")
    return out


def asked(spark: SparkSession, text: str) -> tuple[list[str], bool]:
    """The stems of a query's words, and whether it must have a full-text hit."""
    row = spark.range(1).select(T.stems(F.lit(text)).alias("terms"), memory_search.needs_word_hit(F.lit(text)).alias("must")).first()
    return list(dict.fromkeys(row["terms"])), row["must"]


def recall(memories: DataFrame, query_vector: DataFrame, text: str, as_of: str, limit: int | None = None, memory_types: str | None = None, tags: str | None = None, organization: str | None = None, project: str | None = None) -> DataFrame:
    """What a query recalls, best first: id, score, match_type, memory_type, content (cut at 2,000 bytes), tags, importance, created_at, access_count.

    A blank query recalls nothing. Words are compared by stem, over content and,
    where there is one, summary.
    """
    content = F.concat_ws(" ", "content", "summary") if "summary" in memories.columns else F.col("content")
    terms, must_hit = asked(memories.sparkSession, text)
    scope = {k: v for k, v in (("organization", organization), ("project", project)) if v is not None}
    n = clamped(limit, RECALLED)
    shown = [c for c in ("summary", "tags", "importance", "created_at", "access_count") if c in memories.columns]
    best = memory_search.hybrid_recall(memories if text.strip() else memories.where(F.lit(False)), query_vector, terms, n, as_of, kinds(memory_types), listed(tags), must_hit=must_hit, words=T.stems(content), keep=["content", *shown], **scope)
    return best.withColumn("content", T.truncated(F.col("content")))


def stored(store: DataFrame, new: DataFrame, as_of: str) -> DataFrame:
    """What storing a batch of new memories (id, content, embedding) tells of each: id, contradictions, long_note.

    Contradictions are the three nearest memories of the store at a similarity
    of 0.75 or more, with their similarity to two decimals. The memories of the
    batch aren't compared with one another; their ids aren't in the store.
    """
    live = store.where(memory_search.live(as_of))
    near = memory_search.nearest_in_blocks(live, new, TOLD, CONTRADICTION)
    told = F.struct("rank", "id", F.round("sim", 2).alias("similarity"), "content", "memory_type")
    lists = near.join(live.select("id", "content", "memory_type"), "id").groupBy("query_id").agg(F.sort_array(F.collect_list(told)).alias("contradictions"))
    out = new.join(lists, F.col("id") == F.col("query_id"), "left")
    empty = F.filter("contradictions", lambda c: F.lit(False))
    return out.select("id", F.coalesce("contradictions", empty, F.array()).alias("contradictions"), (F.octet_length("content") > 2000).alias("long_note"))


def judged(store: DataFrame, rows: DataFrame, content: str, order: Sequence[str], long_enough: Column) -> DataFrame:
    """Adds `state` to rows that come in the order given, which tells them apart: short, duplicate or stored.

    A row is a duplicate if the store or a long enough row before it has the
    same fingerprint. The first of each fingerprint is found by a minimum, and
    rows meet it by fingerprint and place, so no text's copies meet in one task.
    """
    keyed = rows.withColumns({"long_": F.coalesce(long_enough, F.lit(False)), "fp_": T.fingerprint(F.coalesce(F.col(content), F.lit(""))), "place_": F.struct(*order)})
    first = keyed.where("long_").groupBy("fp_").agg(F.min("place_").alias("place_"))
    fresh = first.join(store.select(T.fingerprint(F.col("content")).alias("fp_")).distinct(), "fp_", "left_anti").withColumn("fresh_", F.lit(True))
    out = keyed.join(fresh, ["fp_", "place_"], "left")
    state = F.when(~F.col("long_"), "short").when(F.col("fresh_"), "stored").otherwise("duplicate")
    return out.withColumn("state", state).drop("fp_", "place_", "long_", "fresh_")


def documents_ingested(store: DataFrame, files: DataFrame, project: str) -> DataFrame:
    """The sections of markdown files (file_path, content) as memories, with their state.

    A file that isn't text (null content) gives one row of the state `unreadable`.
    """
    stem = F.regexp_replace(F.substring_index("file_path", "/", -1), r"(?<=.)\.[^.]*$", "")
    parts = ingest.sections(files.where("content is not null").select("file_path", F.replace("content", F.lit("\r\n"), F.lit("\n")).alias("content")))
    body = F.regexp_replace("section", r"\n\z", "")
    rows = judged(store, parts.select("file_path", "section_no", "title", "stored", body.alias("content")), "content", ["file_path", "section_no"], F.col("stored"))
    unread = files.where("content is null").select("file_path", F.lit(0).alias("section_no"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("content"), F.lit("unreadable").alias("state"))
    kind = ingest.memory_type_of_stem(stem)
    return rows.drop("stored").unionByName(unread).select(
        "file_path", "section_no", "content", F.concat_ws(": ", "file_path", "title").alias("summary"), kind.alias("memory_type"), ingest.importance_of(kind).alias("importance"),
        F.array(F.lit("docs"), F.lit("markdown"), ingest.slug(stem)).alias("tags"), F.lit(project).alias("project"), "state",
    )


def pull_requests_ingested(store: DataFrame, rows: DataFrame, repository: str, order: Sequence[str], body: str = "json") -> DataFrame:
    """Pull requests in JSON as memories, with their state; `order` tells the rows apart and says which come first."""
    if not ingest.valid_repository(repository):
        raise ValueError(f"not owner/name: {repository}")
    pr = ingest.pull_requests(rows, body)
    head = F.concat(F.lit("PR #"), F.col("number").cast("string"), F.lit(": "), F.col("title"))
    told = pr.withColumns({"summary": head, "content": F.concat(head, F.lit("\n\n"), F.col("body"))})
    out = judged(store, told, "content", order, F.col("stored"))
    return out.select(*order, "content", "summary", "memory_type", F.lit(0.6).alias("importance"), F.array(F.lit("github"), F.lit("pull-request")).alias("tags"), F.lit(repository.split("/")[1]).alias("project"), F.col("url").alias("identifier"), "author", "state")


def counts(ingested: DataFrame) -> DataFrame:
    """One row: memories_stored, memories_skipped, errors (none: embeddings are given here)."""
    stored_ = F.col("state") == "stored"
    return ingested.agg(F.count_if(stored_).alias("memories_stored"), F.count_if(~stored_).alias("memories_skipped"), F.lit(0).cast("long").alias("errors"))
