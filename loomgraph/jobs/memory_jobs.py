"""Registered queries on memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import ingest, memory_search, memory_store
from loomgraph.sources.tables import table
from loomgraph.views import AS_OF, memories, with_ctes

TERMS = ("that", "then")
LIMIT = 10


def query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector that the searches ask for: that of id 0."""
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("query_vector"))


def mem_semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_search.semantic_topk(memories(spark, sf_dir), query_vector(spark, sf_dir), LIMIT, "2020-01-01 00:00:00").select("id", F.round("sim", 6).alias("sim"), "rank")


def mem_semantic_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_search.semantic_topk(memories(spark, sf_dir), query_vector(spark, sf_dir), LIMIT, AS_OF, 0.0, project="src0").select("id", F.round("sim", 6).alias("sim"), "rank")


def mem_fulltext_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_search.fulltext_topk(memories(spark, sf_dir), TERMS, LIMIT, AS_OF).select("id", F.round("text_score", 6).alias("text_score"), "rank")


def mem_fulltext_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memory_search.fulltext_topk(memories(spark, sf_dir), ("ere",), LIMIT, AS_OF, words=T.stems(F.col("content")))
    return rows.select("id", F.round("text_score", 6).alias("text_score"), "rank")


def mem_rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir)
    out = memory_search.fused(memory_search.semantic_topk(m, query_vector(spark, sf_dir), 20, AS_OF), memory_search.fulltext_topk(m, TERMS, 20, AS_OF))
    return out.select("id", F.round("rrf", 9).alias("rrf"), "match_type")


def mem_hybrid_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_search.hybrid_recall(memories(spark, sf_dir), query_vector(spark, sf_dir), TERMS, LIMIT, AS_OF)


def mem_hybrid_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_search.hybrid_recall(memories(spark, sf_dir), query_vector(spark, sf_dir), TERMS, 40, AS_OF, types=("decision", "pattern", "guideline", "incident"), tags=("en",))


def mem_hybrid_strict_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_search.hybrid_recall(memories(spark, sf_dir), query_vector(spark, sf_dir), TERMS, LIMIT, AS_OF, organization="org1")


def mem_hybrid_scope_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_search.hybrid_recall(memories(spark, sf_dir), query_vector(spark, sf_dir), TERMS, LIMIT, AS_OF, strict_scope=False, organization="org1")


def mem_lexical_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("q"))
    return q.select("conv_id", "turn", memory_search.needs_word_hit(F.col("q")).alias("must_hit"))


def mem_decay_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).select("id", F.round(memory_search.relevance(AS_OF), 9).alias("relevance"))


def mem_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return memory_search.nearest_in_blocks(v, v.where("id % 100 = 0"), 3, 0.25)


def mem_fingerprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_store.first_of_each(memories(spark, sf_dir)).select("keep_id", "copies")


def mem_find_by_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = memory_store.first_of_each(memories(spark, sf_dir))
    asked = table(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.upper("text")).alias("fingerprint"))
    return asked.join(store, "fingerprint").select("doc_id", "keep_id")


def mem_count_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_store.counted(memories(spark, sf_dir), "organization", "team", "project")


def mem_get_bumped(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir)
    return memory_store.bumped(m, m.where(F.array_contains("tags", "en"))).select("id", "access_count")


def mem_partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir).withColumn("updated_at", F.col("created_at"))
    out = memory_store.updated(m, F.col("id") % 7 == 0, {"importance": F.lit(0.95), "tags": F.array_append("tags", F.lit("pinned"))}, AS_OF)
    return out.select("id", "importance", F.size("tags").cast("long").alias("n_tags"), "updated_at")


def mem_delete_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return memory_store.deleted(memories(spark, sf_dir), gone).select("id", "project")


def mem_upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file_path"), F.col("p_size").alias("start_line"))
    new = p.where("id % 5 = 0").select((F.col("id") * 2).alias("id"), F.concat(F.col("name"), F.lit(" v2")).alias("name"), F.lit("moved").alias("file_path"), (F.col("start_line") + 1).alias("start_line"))
    return memory_store.merged(p, new, ["id"], keep_old=["file_path"])


def mem_insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    seed = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 3).alias("id"), F.lit("seed").alias("source"))
    return memory_store.inserted_new(d, seed)


def mem_type_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    stem = F.regexp_extract(F.col("text"), r"^[^\n]*", 0)
    kind = ingest.memory_type_of_stem(stem)
    return d.select("doc_id", kind.alias("by_stem"), ingest.memory_type_of_title(stem).alias("by_title"), ingest.importance_of(kind).alias("importance"), ingest.slug(stem).alias("slug"))


def mem_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.length(T.truncated(F.col("text"))).cast("long").alias("n_chars_shown"), (F.octet_length("text") > 2000).alias("long_note"))


def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as markdown: a section per turn."""
    c = table(spark, sf_dir, "conversations")
    part = F.concat(F.lit("## "), F.col("role"), F.lit("\n"), F.regexp_replace("text", r"(?m)^## ", "# "))
    ordered = F.sort_array(F.collect_list(F.struct("turn", part.alias("part"))))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n").alias("content"))


def ingest_md_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.sections(markdown_files(spark, sf_dir))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_sections"), F.count_if(F.col("title") == "user").alias("n_user"))


def ingest_dedup_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").where(F.octet_length(F.trim("text")) >= 50)
    return memory_store.ingested(memories(spark, sf_dir), batch, "text", ["conv_id", "turn"]).select("conv_id", "turn")


def ingest_pr_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type")
    json = F.to_json(F.struct(F.col("k").alias("number"), F.concat(F.lit("Fix "), F.col("event_type")).alias("title"), F.repeat(F.lit("word "), F.coalesce(F.col("k"), F.lit(0)).cast("int")).alias("body")))
    return ingest.pull_requests(rows.select("event_id", json.alias("json"))).select("event_id", "number", "memory_type", "author", "stored")


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.views import relationships, symbols

    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    return one("memories", memories(spark, sf_dir)).unionByName(one("symbols", symbols(spark, sf_dir))).unionByName(one("relationships", relationships(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (mem_semantic_topk, mem_semantic_scoped, mem_fulltext_topk, mem_fulltext_stemmed, mem_rrf_fusion, mem_hybrid_recall, mem_hybrid_filtered, mem_hybrid_strict_scope, mem_hybrid_scope_leak, mem_lexical_guard, mem_decay_score, mem_near_duplicates, mem_fingerprint_dedup, mem_find_by_fingerprint, mem_count_scope, mem_get_bumped, mem_partial_update, mem_delete_antijoin, mem_upsert_merge, mem_insert_new, mem_type_classify, mem_truncate, ingest_md_sections, ingest_dedup_batch, ingest_pr_json, status_counts)}

_LIVE = f"(expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF}')"
_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(content, '')), '[^a-z0-9_]+'), lambda t: t <> '')"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_STEMS = f"list_transform(list_filter({_WORDS}, lambda t: NOT list_contains([{_STOP}], t)), lambda t: CASE WHEN regexp_matches(t, 'ies$') AND NOT regexp_matches(t, '(e|a)ies$') THEN regexp_replace(t, 'ies$', 'y') WHEN regexp_matches(t, 'es$') AND NOT regexp_matches(t, '(a|e|o)es$') THEN regexp_replace(t, 'es$', 'e') WHEN regexp_matches(t, 's$') AND NOT regexp_matches(t, '(u|s)s$') THEN regexp_replace(t, 's$', '') ELSE t END)"
_NORM = "trim(regexp_replace(lower({0}), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


def _sem(k: int, where: str = "true", least: float = -1.0) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY sim DESC, id) AS rank FROM (SELECT id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 9) AS sim FROM mem WHERE embedding IS NOT NULL AND {where}) WHERE sim >= {least} ORDER BY sim DESC, id LIMIT {k}"


def _ft(k: int, terms: tuple[str, ...] = TERMS, where: str = "true", words: str = _WORDS) -> str:
    wanted = "[" + ", ".join(f"'{t}'" for t in terms) + "]"
    return f"SELECT *, row_number() OVER (ORDER BY text_score DESC, id) AS rank FROM (SELECT id, round(len(list_filter(w, lambda t: list_contains({wanted}, t))) / (1 + ln(len(w)::DOUBLE)), 9) AS text_score FROM (SELECT id, {words} AS w FROM mem WHERE {_LIVE} AND {where}) WHERE len(list_intersect({wanted}, w)) = {len(terms)}) ORDER BY text_score DESC, id LIMIT {k}"


_REL = f"least(greatest(exp(-0.002 * greatest(0, floor(epoch(TIMESTAMP '{AS_OF}' - created_at) / 86400))) * importance + least(0.03 * access_count, 0.2), 0.1), 1.0)"


def _hybrid(limit: int, scope: str = "true", text_scope: str = "true", where: str = "true") -> str:
    return with_ctes(f"""WITH s AS ({_sem(2 * limit, f"{_LIVE} AND {scope}", 0.0)}), f AS ({_ft(2 * limit, where=text_scope)}),
u AS (SELECT coalesce(s.id, f.id) AS id, coalesce(1.0::DOUBLE / (60 + s.rank), 0) + coalesce(1.0::DOUBLE / (60 + f.rank), 0) AS rrf, CASE WHEN s.id IS NULL THEN 'fulltext' WHEN f.id IS NULL THEN 'semantic' ELSE 'hybrid' END AS match_type FROM s FULL JOIN f ON s.id = f.id)
SELECT id, round(rrf * (0.7 + 0.3 * {_REL}), 9) AS score, match_type, memory_type FROM u JOIN mem USING (id) WHERE {where} ORDER BY score DESC, id LIMIT {limit}""", "mem")


_STEM = "regexp_extract(text, '^[^\\n]*')"
_KIND = f"CASE WHEN regexp_matches(lower({_STEM}), 'architecture|design|(-adr|-decision)$|^adr[-_]') THEN 'architecture' WHEN regexp_matches(lower({_STEM}), 'contributing|guideline|style|conduct') THEN 'guideline' ELSE 'code_context' END"

ORACLES = {
    "mem_semantic_topk": with_ctes(f"SELECT id, round(sim, 6) AS sim, rank::INTEGER AS rank FROM ({_sem(LIMIT, "(expires_at IS NULL OR expires_at > TIMESTAMP '2020-01-01')")})", "mem"),
    "mem_semantic_scoped": with_ctes(f"SELECT id, round(sim, 6) AS sim, rank::INTEGER AS rank FROM ({_sem(LIMIT, f"{_LIVE} AND project = 'src0'", 0.0)})", "mem"),
    "mem_fulltext_topk": with_ctes(f"SELECT id, round(text_score, 6) AS text_score, rank::INTEGER AS rank FROM ({_ft(LIMIT)})", "mem"),
    "mem_fulltext_stemmed": with_ctes(f"SELECT id, round(text_score, 6) AS text_score, rank::INTEGER AS rank FROM ({_ft(LIMIT, ('ere',), words=_STEMS)})", "mem"),
    "mem_rrf_fusion": with_ctes(f"WITH s AS ({_sem(20, _LIVE)}), f AS ({_ft(20)}) SELECT coalesce(s.id, f.id) AS id, round(coalesce(1.0::DOUBLE / (60 + s.rank), 0) + coalesce(1.0::DOUBLE / (60 + f.rank), 0), 9) AS rrf, CASE WHEN s.id IS NULL THEN 'fulltext' WHEN f.id IS NULL THEN 'semantic' ELSE 'hybrid' END AS match_type FROM s FULL JOIN f ON s.id = f.id", "mem"),
    "mem_hybrid_recall": _hybrid(LIMIT),
    "mem_hybrid_filtered": _hybrid(40, where="memory_type IN ('decision', 'pattern', 'guideline', 'incident') AND list_contains(tags, 'en')"),
    "mem_hybrid_strict_scope": _hybrid(LIMIT, "organization = 'org1'", "organization = 'org1'"),
    "mem_hybrid_scope_leak": _hybrid(LIMIT, "organization = 'org1'"),
    "mem_lexical_guard": "WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM conversations) SELECT conv_id, turn, len(w) <= 1 OR len(list_filter(w, lambda x: contains(x, '_') OR (octet_length(encode(x)) >= 8 AND NOT regexp_matches(x, '[a-z]')))) > 0 AS must_hit FROM w",
    "mem_decay_score": with_ctes(f"SELECT id, round({_REL}, 9) AS relevance FROM mem", "mem"),
    "mem_near_duplicates": "SELECT query_id, id, sim, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS sim FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id) WHERE sim >= 0.25) WHERE rank <= 3",
    "mem_fingerprint_dedup": f"SELECT min(doc_id) AS keep_id, count(*) AS copies FROM documents GROUP BY {_NORM.format('text')}",
    "mem_find_by_fingerprint": f"WITH s AS (SELECT {_NORM.format('text')} AS fp, min(doc_id) AS keep_id FROM documents GROUP BY 1) SELECT doc_id, keep_id FROM documents JOIN s ON fp = {_NORM.format('upper(text)')}",
    "mem_count_scope": with_ctes("SELECT organization, team, project, count(*) AS n FROM mem GROUP BY ALL", "mem"),
    "mem_get_bumped": with_ctes("SELECT id, (access_count + CASE WHEN list_contains(tags, 'en') THEN 1 ELSE 0 END)::INTEGER AS access_count FROM mem", "mem"),
    "mem_partial_update": with_ctes(f"SELECT id, CASE WHEN id % 7 = 0 THEN 0.95::DOUBLE ELSE importance END AS importance, (len(tags) + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_tags, CASE WHEN id % 7 = 0 THEN TIMESTAMP '{AS_OF}' ELSE created_at END AS updated_at FROM mem", "mem"),
    "mem_delete_antijoin": "SELECT doc_id AS id, source AS project FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)",
    "mem_upsert_merge": "WITH n AS (SELECT p_partkey * 2 AS id, p_name || ' v2' AS name, 'moved' AS file_path, p_size + 1 AS start_line FROM part WHERE p_partkey % 5 = 0) SELECT coalesce(p_partkey, id) AS id, coalesce(name, p_name) AS name, coalesce(p_brand, file_path) AS file_path, coalesce(start_line, p_size)::INTEGER AS start_line FROM part FULL JOIN n ON p_partkey = id",
    "mem_insert_new": "SELECT doc_id AS id, source FROM documents UNION ALL SELECT vec_id * 3, 'seed' FROM embeddings WHERE NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = vec_id * 3)",
    "mem_type_classify": f"SELECT doc_id, {_KIND} AS by_stem, CASE WHEN contains(lower({_STEM}), 'fix') OR contains(lower({_STEM}), 'bug') THEN 'error_pattern' WHEN contains(lower({_STEM}), 'refactor') THEN 'pattern' ELSE 'decision' END AS by_title, CASE {_KIND} WHEN 'architecture' THEN 0.8::DOUBLE WHEN 'guideline' THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END AS importance, translate(lower({_STEM}), ' /', '--') AS slug FROM documents",
    "mem_truncate": "WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, octet_length(encode(text)) AS size FROM documents), c AS (SELECT r, unnest(range(1, least(length(text), 2000) + 1)) AS i FROM d WHERE size > 2000), n AS (SELECT r, count(*) FILTER (upto <= 2000) AS n FROM (SELECT r, sum(octet_length(encode(substr(text, i, 1)))) OVER (PARTITION BY r ORDER BY i) AS upto FROM c JOIN d USING (r)) GROUP BY r) SELECT doc_id, CASE WHEN size <= 2000 THEN length(text) ELSE n + length('...[truncated]') END::BIGINT AS n_chars_shown, size > 2000 AS long_note FROM d LEFT JOIN n USING (r)",
    "ingest_md_sections": "SELECT conv_id, count(*) AS n_sections, count(*) FILTER (role = 'user') AS n_user FROM conversations GROUP BY conv_id",
    "ingest_dedup_batch": f"WITH b AS (SELECT conv_id, turn, {_NORM.format('text')} AS fp, row_number() OVER (PARTITION BY {_NORM.format('text')} ORDER BY conv_id, turn) AS r FROM conversations WHERE octet_length(encode(trim(text))) >= 50) SELECT conv_id, turn FROM b WHERE r = 1 AND fp NOT IN (SELECT {_NORM.format('text')} FROM documents WHERE text IS NOT NULL)",
    "ingest_pr_json": "SELECT event_id, coalesce((props::JSON->>'$.k')::BIGINT, 0) AS number, CASE WHEN event_type IS NULL THEN 'decision' ELSE 'error_pattern' END AS memory_type, 'unknown' AS author, octet_length(encode(trim(repeat('word ', coalesce((props::JSON->>'$.k')::BIGINT, 0))))) >= 50 AS stored FROM events",
    "status_counts": with_ctes("SELECT 'memories' AS what, count(*) AS n FROM mem UNION ALL SELECT 'symbols', count(*) FROM sym UNION ALL SELECT 'relationships', count(*) FROM rel", "mem", "sym", "rel"),
}
