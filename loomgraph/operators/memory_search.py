"""Searching memories: by vector, by words, and by both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import tokens

#: Constant of reciprocal-rank fusion.
RRF_K = 60
#: Vectors that meet a block of queries at once; a bound on memory.
ROWS_AT_ONCE = 1024


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors in double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def live(as_of: str) -> Column:
    """Not expired at the moment."""
    return F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of).cast("timestamp_ntz"))


def in_scope(organization: str | None = None, team: str | None = None, project: str | None = None) -> Column:
    """All given parts of the scope hold."""
    out = F.lit(True)
    for name, value in (("organization", organization), ("team", team), ("project", project)):
        if value is not None:
            out = out & (F.col(name) == value)
    return out


def semantic_topk(memories: DataFrame, query: DataFrame, k: int, as_of: str, min_similarity: float = -1.0, **scope: str | None) -> DataFrame:
    """The k memories nearest to the one-row `query` (column query_vector): id, sim, rank.

    Memories without a vector, expired or out of scope are left out. Ties go to
    the smaller id. The limit is a top-k sort, so no full sort is shuffled.
    """
    rows = memories.where(F.col("embedding").isNotNull() & live(as_of) & in_scope(**scope)).select("id", "embedding")
    sims = rows.crossJoin(F.broadcast(query.limit(1))).select("id", F.round(cosine(F.col("embedding"), F.col("query_vector")), 9).alias("sim"))
    top = sims.where(F.col("sim") >= min_similarity).orderBy(F.desc("sim"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("sim"), "id")))


def fulltext_topk(memories: DataFrame, terms: Sequence[str], k: int, as_of: str, words: Column | None = None, **scope: str | None) -> DataFrame:
    """The k memories that hold all terms, by term count over 1 + ln(length): id, text_score, rank; none without terms."""
    wanted = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    rows = memories.where(F.lit(bool(terms)) & live(as_of) & in_scope(**scope)).select("id", (tokens(F.col("content")) if words is None else words).alias("words"))
    rows = rows.where(F.size(F.array_except(wanted, "words")) == 0)
    hits = F.size(F.filter("words", lambda w: F.array_contains(wanted, w)))
    top = rows.select("id", F.round(hits / (1 + F.log(F.size("words").cast("double"))), 9).alias("text_score")).orderBy(F.desc("text_score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("text_score"), "id")))


def fused(semantic: DataFrame, fulltext: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion: id, rrf, match_type (hybrid, semantic or fulltext)."""
    both = semantic.select("id", "rank", F.lit(1).alias("s"), F.lit(0).alias("f")).unionByName(fulltext.select("id", "rank", F.lit(0).alias("s"), F.lit(1).alias("f")))
    out = both.groupBy("id").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("rrf"), F.max("s").alias("s"), F.max("f").alias("f"))
    kind = F.when((F.col("s") == 1) & (F.col("f") == 1), "hybrid").when(F.col("s") == 1, "semantic").otherwise("fulltext")
    return out.select("id", "rrf", kind.alias("match_type"))


def relevance(as_of: str) -> Column:
    """Decay by age in days, scaled by importance, with a boost for access; between 0.1 and 1."""
    days = F.greatest(F.lit(0), F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 86_400_000_000))
    raw = F.exp(-0.002 * days) * F.col("importance") + F.least(0.03 * F.col("access_count"), F.lit(0.2))
    return F.least(F.greatest(raw, F.lit(0.1)), F.lit(1.0))


def needs_word_hit(query: Column) -> Column:
    """Whether a query is of a kind that must have a full-text hit: at most one word, a word with `_`, or one of 8 or more bytes without lower-case letters."""
    words = F.filter(F.split(query, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    marked = F.exists(words, lambda w: w.contains("_") | ((F.octet_length(w) >= 8) & ~w.rlike("[a-z]")))
    return (F.size(words) <= 1) | marked


def hybrid_recall(memories: DataFrame, query: DataFrame, terms: Sequence[str], limit: int, as_of: str, types: Sequence[str] = (), tags: Sequence[str] = (), min_similarity: float = 0.0, strict_scope: bool = True, must_hit: bool = False, words: Column | None = None, keep: Sequence[str] = (), semantic: DataFrame | None = None, fulltext: DataFrame | None = None, **scope: str | None) -> DataFrame:
    """The best memories by fused ranks and relevance: id, score, match_type, memory_type, and the columns to keep.

    Both searches fetch twice the limit; types and tags (all of them) are
    filtered after fusion. `strict_scope` keeps full-text hits in scope too.
    With `must_hit` and no full-text hit, nothing is found. `words` are the
    memories' words; by default the tokens of the content. Searches of an index
    can stand for either scan: `semantic` (id, rank) and `fulltext` (id, rank).
    """
    if semantic is None:
        semantic = semantic_topk(memories, query, 2 * limit, as_of, min_similarity, **scope)
    if fulltext is None:
        fulltext = fulltext_topk(memories, terms, 2 * limit, as_of, words, **(scope if strict_scope else {}))
    found = fused(semantic, fulltext)
    if must_hit:
        found = found.join(F.broadcast(fulltext.select(F.lit(True).alias("hit")).limit(1)), how="cross").drop("hit")
    rows = memories.join(F.broadcast(found), "id")
    if types:
        rows = rows.where(F.col("memory_type").isin(*types))
    if tags:
        rows = rows.where(F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0)
    score = F.round(F.col("rrf") * (0.7 + 0.3 * relevance(as_of)), 9)
    return rows.select("id", score.alias("score"), "match_type", "memory_type", *keep).orderBy(F.desc("score"), "id").limit(limit)


def nearest_in_blocks(vectors: DataFrame, queries: DataFrame, k: int, min_similarity: float, block: int = 4096) -> DataFrame:
    """For each query vector, its k nearest other vectors: query_id, id, sim, rank.

    The queries are dealt to blocks of bounded size. Each block is broadcast
    and meets all vectors where they are read, as matrix products; only the k
    best of a batch go on to the ranking. Ids are whole numbers or strings.
    """
    import numpy as np
    import pyarrow as pa

    spark = vectors.sparkSession
    vectors, queries = vectors.where("embedding is not null").select("id", "embedding"), queries.where("embedding is not null").select("id", "embedding")
    kind = "string" if vectors.schema["id"].dataType.simpleString() == "string" else "long"
    texts = kind == "string"

    def searcher(shared):
        def nearest(batches):
            ids_q, q = shared.value
            for batch in batches:
                ids = np.array(batch.column("id").to_pylist(), str) if texts else batch.column("id").to_numpy()
                for at in range(0, len(ids), ROWS_AT_ONCE):
                    some = slice(at, at + ROWS_AT_ONCE)
                    v = batch.column("embedding")[some].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, q.shape[1])
                    sims = np.round((q @ v.T) / np.maximum(np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)), 1e-300), 6)
                    sims[ids_q[:, None] == ids[None, some]] = -2.0
                    least = np.full(len(q), min_similarity)
                    if sims.shape[1] > k:
                        least = np.maximum(least, np.partition(sims, -k, axis=1)[:, -k])
                    i, j = np.nonzero(sims >= least[:, None])  # ties with the k-th included
                    order = np.lexsort((ids[some][j], -sims[i, j], i))
                    i, j = i[order], j[order]
                    starts = np.flatnonzero(np.diff(i, prepend=-1))
                    place = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))
                    i, j = i[place < k], j[place < k]
                    yield pa.RecordBatch.from_arrays([pa.array(ids_q[i]), pa.array(ids[some][j]), pa.array(sims[i, j])], names=["query_id", "id", "sim"])

        return nearest

    n, found = -(-queries.count() // block), None
    for b in range(max(n, 1)):
        some = queries.where(F.pmod(F.xxhash64("id"), F.lit(max(n, 1))) == b).orderBy("id").toPandas()
        if some.empty:
            continue
        shared = spark.sparkContext.broadcast((some["id"].to_numpy(str if texts else None), np.array(some["embedding"].tolist(), np.float64).reshape(len(some), -1)))
        part = vectors.mapInArrow(searcher(shared), f"query_id {kind}, id {kind}, sim double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"query_id {kind}, id {kind}, sim double")
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
