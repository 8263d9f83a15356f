"""The stored indexes against scans and brute force: words, stems, segments, cells."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions.english import ENGLISH_STOP_WORDS, english_stem, english_stems
from loomgraph.operators import inverted_index, memory_search
from loomgraph.operators.inverted_index import InvertedIndex
from loomgraph.operators.vector_index import VectorIndex, recall
from loomgraph.sources.derived import kept, shared_folder

AS_OF = "2025-01-01 00:00:00"
#: From the published sample of the Porter2 algorithm: words and stems.
SAMPLE = """consign consign consigned consign consignment consign consistency consist consolation consol consolatory consolatori consolidating consolid consolingly consol
conspicuously conspicu conspiracy conspiraci conspirator conspir constance constanc constant constant knackeries knackeri knavish knavish kneeled kneel knightly knight
knives knive knocker knocker knopped knop generously generous communities communiti dying die skies sky happily happili cries cri ties tie gas gas gaps gap hopping hop
hoping hope proceed proceed luxuriated luxuri agreed agre relational relat rationalize ration sensibility sensibl hesitancy hesit digitizer digit operator oper
feudalism feudal decisiveness decis hopefulness hope callousness callous formality formal electricity electr replacement replac adoption adopt rate rate cease ceas
controlling control rolled roll youth youth boyish boyish sayings say by by tied tie""".split()


def test_english_stems():
    got = {w: english_stem(w) for w in SAMPLE[::2]}
    assert got == dict(zip(SAMPLE[::2], SAMPLE[1::2], strict=True))


def test_stems_of_texts(spark):
    df = spark.createDataFrame([(1, "The Runners were running, then ran to THEIR houses!"), (2, None), (3, ""), (4, "the of and")], "id long, text string")
    got = {r.id: r.s for r in df.select("id", english_stems(F.col("text")).alias("s")).collect()}
    assert got == {1: ["runner", "run", "ran", "hous"], 2: [], 3: [], 4: []}
    assert len(set(ENGLISH_STOP_WORDS)) == 127


@pytest.fixture(scope="module")
def memories(spark):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta"] + [f"w{i}" for i in range(60)]
    rows = []
    for i in range(400):
        text = " ".join(rng.choices(words, [40, 20, 5, 1] + [3] * 60, k=rng.randrange(1, 60)))
        rows.append((i, text if i % 50 else None, datetime.datetime(2024, 1, 1) if i % 9 == 0 else None, f"org{i % 3}", "t", f"p{i % 2}"))
    return spark.createDataFrame(rows, "id long, content string, expires_at timestamp_ntz, organization string, team string, project string").repartition(5)


def same(index, memories, terms, k, **scope):
    want = [tuple(r) for r in memory_search.fulltext_topk(memories, list(dict.fromkeys(terms)), k, AS_OF, **scope).collect()]
    for first in (3, 40, 10_000):
        got = [tuple(r) for r in index.topk(terms, k, AS_OF, first_read=first, **scope).collect()]
        assert sorted(got) == sorted(want), (terms, k, first)
    return want


@pytest.fixture(scope="module")
def index(spark, memories, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("inverted"))
    InvertedIndex(spark, folder).add(memories)
    return InvertedIndex(spark, folder)  # opened anew


@pytest.mark.parametrize("terms", [["alpha"], ["delta", "alpha"], ["gamma", "beta", "alpha"], ["beta", "beta"], ["w1", "w2"], ["nowhere"], ["alpha", "nowhere"], []])
def test_index_finds_what_the_scan_finds(index, memories, terms):
    same(index, memories, terms, 7)
    same(index, memories, terms, 5, organization="org1", project="p0")


def test_index_reads_its_terms_only(index):
    plan = index.of_terms(["alpha"])._jdf.queryExecution().explainString(index.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("\n")[0]
    assert "EqualTo(term,alpha)" in plan or "In(term, [alpha])" in plan


def test_search_stops_at_the_bound(index, monkeypatch):
    """With many postings of falling scores, the lowest bands of a lone term aren't read."""
    asked = []
    real = InvertedIndex.of_terms
    monkeypatch.setattr(InvertedIndex, "of_terms", lambda self, terms, where=None: asked.append(str(where)) or real(self, terms, where))
    index.topk(["alpha"], 1, AS_OF, first_read=10)
    bands = index._read("terms", inverted_index.TERMS).where("term = 'alpha'").select("band").distinct().count()
    assert 1 <= len(asked) < bands
    lowest = index._read("terms", inverted_index.TERMS).where("term = 'alpha'").agg(F.min("band")).first()[0]
    assert not any(f"(band >= {lowest})" in a for a in asked)


def test_segments_replacements_removals_and_compaction(spark, memories, tmp_path):
    index = InvertedIndex(spark, str(tmp_path))
    index.add(memories.where("id < 200"))
    index.add(memories.where("id >= 200"))
    same(index, memories, ["beta", "alpha"], 9)
    new = memories.where("id % 4 = 0").withColumn("content", F.lit("alpha beta delta"))
    index.add(new)
    index.remove(memories.where("id % 10 = 3"))
    now = memories.where("id % 4 <> 0").unionByName(new).where("id % 10 <> 3")
    same(index, now, ["delta", "alpha"], 9)
    again = InvertedIndex(spark, str(tmp_path))
    same(again, now, ["alpha"], 9)
    again.compact()
    assert [kind for _, kind, _ in again.entries] == ["postings", "terms"]
    same(InvertedIndex(spark, str(tmp_path)), now, ["delta", "alpha"], 9)
    # What was removed may come back.
    again.add(memories.where("id = 3"))
    same(again, now.unionByName(memories.where("id = 3")), ["alpha"], 400)


def test_half_written_batch_counts_for_nothing(spark, memories, tmp_path, monkeypatch):
    index = InvertedIndex(spark, str(tmp_path))
    index.add(memories.where("id < 100"))
    monkeypatch.setattr(InvertedIndex, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        index.add(memories)
    monkeypatch.undo()
    same(InvertedIndex(spark, str(tmp_path)), memories.where("id < 100"), ["alpha"], 9)


def test_empty_index(spark, tmp_path, memories):
    index = InvertedIndex(spark, str(tmp_path))
    assert index.topk(["alpha"], 3, AS_OF).count() == 0
    index.add(memories.limit(0))
    assert InvertedIndex(spark, str(tmp_path)).topk(["alpha"], 3, AS_OF).count() == 0


def test_recall_by_either_search(spark, memories, index):
    m = memories.withColumns({"memory_type": F.lit("decision"), "tags": F.array(), "importance": F.lit(0.5), "access_count": F.lit(1), "created_at": F.lit("2024-05-01").cast("timestamp_ntz"), "embedding": F.array(F.col("id") * 1.0, F.lit(7.0))})
    asked = spark.createDataFrame([([3.0, 1.0],)], "query_vector array<double>")
    scan = memory_search.hybrid_recall(m, asked, ["alpha"], 10, AS_OF)
    found = memory_search.hybrid_recall(m, asked, ["alpha"], 10, AS_OF, fulltext=index.topk(["alpha"], 20, AS_OF))
    assert [tuple(r) for r in scan.collect()] == [tuple(r) for r in found.collect()]


def brute(rows, queries, k, least):
    out = []
    for q, a in queries:
        sims = [(round(float(np.dot(a, v) / max(np.linalg.norm(a) * np.linalg.norm(v), 1e-300)), 6), i) for i, v in rows if i != q]
        best = sorted((-s, i) for s, i in sims if s >= least)[:k]
        out += [(q, i, -s, n + 1) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 16])
def test_vectors_in_cells(spark, tmp_path, monkeypatch, block):
    """Clusters, a third of equal vectors, unstructured ones: the exact search equals brute force, the other finds nearly all."""
    from loomgraph.operators import vector_index

    monkeypatch.setattr(vector_index, "BLOCK", block)
    shared = shared_folder(spark)
    assert shared
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 8))
    v = [(int(i), (centres[i % 10] + rng.normal(size=8) * 0.05 if i % 3 == 0 else np.ones(8) if i % 3 == 1 else rng.normal(size=8)).tolist()) for i in range(600)]
    df = spark.createDataFrame([*v, (900, None), (None, v[0][1])], "id long, embedding array<double>").repartition(4)
    VectorIndex(spark, str(tmp_path)).build(df, 24)
    index = VectorIndex(spark, str(tmp_path))
    assert index.vectors().count() == 600
    asked = spark.createDataFrame([x for x in v if x[0] % 20 == 0], "id long, embedding array<double>")
    exact = index.nearest(asked, 5, 0.2)
    assert sorted((a, b, round(c, 6), d) for a, b, c, d in (tuple(r) for r in exact.collect())) == brute(v, [x for x in v if x[0] % 20 == 0], 5, 0.2)
    clustered = asked.where("id % 3 = 0")
    r = recall(index.nearest(clustered, 5, 0.2, exact=False, probed=0.1), index.nearest(clustered, 5, 0.2)).first()
    assert r.n_found >= 0.9 * r.n_wanted


def test_empty_vectors(spark, tmp_path):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    VectorIndex(spark, str(tmp_path)).build(none)
    one = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<double>")
    assert VectorIndex(spark, str(tmp_path)).nearest(one, 3).count() == 0


def test_kept_until_the_files_change(spark, tmp_path):
    at = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(at)
    built = []
    ask = lambda: kept(spark, "thing", [spark.read.parquet(at)], lambda folder: built.append(folder) or spark.range(1).write.parquet(folder))
    assert ask() == ask() and len(built) == 1
    spark.range(4).write.mode("overwrite").parquet(at)
    assert ask() == built[1] and len(built) == 2


def test_postings_are_written_where_their_memories_are(spark, memories, tmp_path):
    """No posting is shuffled; the rows of a repeated id still count as one."""
    index = InvertedIndex(spark, str(tmp_path))
    seen = []
    index._save = lambda postings, segment, real=index._save: seen.append(postings) or real(postings, segment)
    index.add(memories)
    assert "hashpartitioning" not in (plan := seen[0]._jdf.queryExecution().executedPlan().toString()) and "rangepartitioning" not in plan
    twice = InvertedIndex(spark, str(tmp_path / "twice"))
    twice.add(memories.where("id < 40").unionByName(memories.where("id < 3")))
    found = {(r.id, r.term): r.n for r in twice.postings().collect()}
    once = {(r.id, r.term): r.n for r in index.postings().where("id < 40").collect()}
    assert found == {k: 2 * n if k[0] < 3 else n for k, n in once.items()}
