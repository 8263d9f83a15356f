"""The conversation trie, the cover trees and the line filters against brute force, on odd and on hot data."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import decontamination, hard_negatives, line_filter, prefix_trie
from loomgraph.llm.common import python_batches, written
from loomgraph.llm.textcodes import mix

BLANK = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def without_lines(rows, documents, characters, keep):
    """Plain version: rows are (id, text)."""
    key = lambda line: lower(line.strip(BLANK))
    where = collections.defaultdict(set)
    for r, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            where[key(line)].add(r)
    gone = {k for k, rs in where.items() if len(k) >= characters and len(rs) >= documents}
    first = {k: min((rows[r][0] is None, rows[r][0] or 0) for r in rs) for k, rs in where.items()}
    out = []
    for i, text in rows:
        lines, kept, seen = (text or "").split("\n"), [], set()
        for line in lines:
            k = key(line)
            stays = k not in gone or (keep == "first" and (i is None, i or 0) == first[k] and k not in seen)
            seen.add(k)
            if stays:
                kept.append(line)
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def lined(spark):
    rng = random.Random(1)
    common = ["Menu", "  MENU\t", "menu ", "É", "é", "x", "", " ", "Read more", "a\rb", "\x0bpage 1", "\x1cpage 1"]
    rows = [(i, "\n".join(rng.choice(common) if rng.random() < 0.4 else f"line {rng.randrange(300)} of {i % 7}" for _ in range(rng.randrange(1, 25)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "\n"), (203, "menu\n" * 30_000), (None, "menu\nof no id")]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, n_lines long").repartition(7)


@pytest.mark.parametrize("few", [line_filter.FEW, 0])
@pytest.mark.parametrize(("documents", "characters", "keep"), [(10, 1, "none"), (2, 1, "first"), (3, 6, "none"), (2, 0, "none")])
def test_lines(lined, documents, characters, keep, few):
    rows, df = lined
    got = sorted((tuple(r) for r in line_filter.deduplicated(df, documents=documents, characters=characters, keep=keep, few=few).collect()), key=repr)
    assert got == without_lines(rows, documents, characters, keep)


def test_filters_lose_no_repeated_line_when_they_are_crowded(spark, monkeypatch):
    """Filters far too small make false suspects only, and segments are told apart."""
    monkeypatch.setattr(line_filter, "SEGMENT_LINES", 64)
    rows = [(i, "\n".join(f"line {j}" for j in range(i, i + 40))) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    found = line_filter.suspects(df, 30, 1).count()
    assert found == sum(sum(i <= j < i + 40 for i in range(100)) >= 30 for j in range(139))
    got = sorted((tuple(r) for r in line_filter.deduplicated(df, documents=30).collect()), key=repr)
    assert got == without_lines(rows, 30, 1, "none")


def test_unknown_rule_of_lines(lined):
    with pytest.raises(ValueError, match="keep"):
        line_filter.deduplicated(lined[1], keep="last")


def trie_rows(rebuilt):
    """Plain version of the expanded trie: rebuilt maps ids to tuples of (role, text)."""
    members = collections.defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(rebuilt[c]) == len(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_trie_by_brute_force(spark, odd_conversations):
    df, turns = odd_conversations
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = tuple(turns.get(base, [])[:h]) + tuple(own[h:])
    ids, steps = prefix_trie.rebuilt(df)
    ids, steps = written(ids, "ids"), written(steps, "steps")
    for batches in (1, 3):
        got = sorted((tuple(r) for r in prefix_trie.expanded(prefix_trie.trie_of(ids, steps, batches)).collect()), key=repr)
        assert got == trie_rows(rebuilt)


@pytest.fixture(scope="module")
def odd_conversations(spark):
    """Deep conversations, a hot first turn, equal conversations, prefixes of others, ties and nulls."""
    rng = random.Random(2)
    turns = {}
    for c in [*range(40), -7, 1000]:
        shape = rng.randrange(4)
        own = [("user", "hello")] if shape else []
        own += [("user" if i % 2 else "bot", f"t{rng.randrange(2)}" if shape == 1 else f"t{i}") for i in range(rng.choice([0, 3, 9, 30]))]
        turns[c] = own or [("", "")]
    turns[50] = [("user", f"deep {i % 3}") for i in range(300)]
    turns[55] = turns[50][:170] + [("bot", "leaves")]
    turns[60] = turns[50][:129]
    rows = [(c, i if i else None, r or None, t or None) for c, own in turns.items() for i, (r, t) in enumerate(own)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5), turns


def test_a_string_is_located_in_few_rounds(spark, odd_conversations):
    df, _ = odd_conversations
    ids, steps = prefix_trie.rebuilt(df)
    trie = prefix_trie.trie_of(written(ids, "ids"), written(steps, "steps"), 1)
    ends = trie.ends().where("length > 0").select(F.col("conv_id").alias("witness"), "length")
    assert trie.locate(ends).where("at <> length or edge is not null").count() == 0
    for r in trie.nodes().collect():
        span = range(r.up + 1, r.length + 1)
        assert r.handle == max(span, key=lambda d: d & -d)


def nearest(rows, anchors, positives, negatives):
    """Plain version: rows are (vec_id, vector of integers, label)."""
    order = lambda x: (-x[0], rows[x[1]][0] is None, rows[x[1]][0] or 0, x[1])
    out = []
    for a, (vec_id, v, label) in enumerate(rows):
        if vec_id is None or vec_id % anchors:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=False)), r) for r, (_, w, _) in enumerate(rows) if r != a]
        best = sorted((s for s in scored if rows[s[1]][2] == label), key=order)[:positives]
        for ps, p in best:
            hard = sorted((s for s in scored if rows[s[1]][2] != label and 80 * ps <= 100 * s[0] <= 100 * ps), key=order)[:negatives]
            out += [(vec_id, rows[p][0], k + 1, rows[n][0], ps, ns) for k, (ns, n) in enumerate(hard)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("big", [1.0, 1e5])
def test_negatives_by_brute_force(spark, big):
    """Clusters, a third of equal vectors, ties, many trees, and products over 2^53."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 5))
    rows = [(i, np.float32((centres[i % 12] + rng.normal(size=5) * 0.05) * big).tolist() if i % 3 else [big] * 5, int(i // 5 % 4)) for i in range(900)]
    rows += [(100, [big, 0.5], 1), (100, [big, 0.5], 1), (None, [big] * 5, 0), (7, [], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(6)
    whole = [(i, [int(np.floor(x * 256)) for x in v], lab) for i, v, lab in rows]
    got = sorted((tuple(r) for r in hard_negatives.mined(df, 50).collect()), key=repr)
    assert got == nearest(whole, 50, 5, 5)


def test_cover_tree_holds_every_row_and_its_radii_cover():
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.integers(-200, 200, (300, 4)), np.tile([[5, 5, 5, 5]], (60, 1))])
    t = hard_negatives.grown(v, np.zeros(len(v), int))
    seen = sorted([*t["centre"][t["fresh"]], *t["order"]])
    assert seen == list(range(len(v)))
    y = np.column_stack([v, np.sqrt(t["longest"][0] ** 2 - (v**2).sum(axis=1))]) / t["longest"][0]

    def below(node):
        own = {int(t["centre"][node]), *map(int, t["order"][t["start"][node] : t["end"][node]])}
        return own.union(*(below(c) for c in range(t["first"][node], t["last"][node])))

    for node in range(len(t["centre"])):
        away = np.arccos(np.clip(y[list(below(node))] @ y[t["centre"][node]], -1, 1))
        assert away.max() <= t["radius"][node] + 1e-6


def test_search_opens_few_nodes_of_clustered_rows():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 32))
    v = np.concatenate([np.floor((c / np.linalg.norm(c) + rng.normal(size=(50, 32)) * 0.01) * 256) for c in centres]).astype(np.int64)
    t = hard_negatives.grown(v, np.zeros(len(v), int))
    t |= {"v": v, "label": np.zeros(len(v), int), "vec_id": np.arange(len(v)), "known": np.ones(len(v), bool), "row": np.arange(len(v))}
    scored = []

    class Counting(hard_negatives.Kept):
        def add(self, queries, score, *rest):
            scored.append(score.size)
            super().add(queries, score, *rest)

    kept = Counting(10, 5)
    at = np.arange(10) * 50
    ends = np.full(10, hard_negatives.NONE + 1), np.full(10, np.iinfo(np.int64).max)
    hard_negatives.descend(t, v[at], np.zeros(10, int), at, *ends, True, kept, 0)
    want = [sorted((-int(v[a] @ v[r]), r) for r in range(len(v)) if r != a)[:5] for a in at]
    assert [[(-s, i) for s, i in zip(*z, strict=True)] for z in zip(kept.score.tolist(), kept.vec_id.tolist(), strict=True)] == want
    assert sum(scored) < 10 * len(v) / 4


def test_setting_of_the_session_is_kept(spark, sf_dir):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with python_batches(spark, 3):
        assert spark.conf.get(name) == "3"
    with pytest.raises(RuntimeError), python_batches(spark, 3):
        raise RuntimeError
    line_filter.op13_line_filters(spark, sf_dir).count()
    assert spark.conf.get(name) == before


def test_hashes_of_lines_differ_by_content_only():
    import pyarrow as pa

    values = ["", "a", "aa", "b", "ab", "a", "é"]
    got = line_filter.hashes(pa.array(values, pa.large_string()))
    assert got[1] == got[5] and len(set(got.tolist())) == 6 and got[0] == mix(np.zeros(1, np.uint64))[0]


def test_pipeline_hands_on_columns_of_any_name(spark, sf_dir):
    import corpus_pipeline

    names = ["score_", "score", "hits_", "hits", "row_key_", "row_key", "class_", "class", "sketch_", "sketch", "row", "copies", "size", "target", "key_", "text_id_", "none", "a.b"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({n: F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")) for n in names})
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        docs = written(out, "stage")
        assert spark.conf.get(setting) == before
        changed = " or ".join(f"`{n}` is null or `{n}` <> concat('{n}:', doc_id)" for n in names)
        assert docs.count() and docs.where(changed).count() == 0, name


@pytest.mark.parametrize("n", [12, 16, 17, 24, 31, 32, 40])
def test_items_of_any_length_have_their_edits(n):
    """An item is found with as many edits as its budget, and with one more it isn't, by one rule from the first length with an edit."""
    item = "q" + "wxyz abcd efgh ijkl mnop qrst uvwx ehlo"[: n - 2] + "k"
    assert len(item) == n
    index = decontamination.Index.of([(1, item)])
    budget = int(n * decontamination.EDIT_SHARE)
    assert (budget > 0) == (n >= decontamination.LEAST)
    for edits in range(budget + 2):
        changed = list(item)
        for e in range(edits):
            changed[2 + 5 * e] = "#"
        found = decontamination._searched(index, ["before it " + "".join(changed) + " and after"])[0]
        assert [h["distance"] for h in found] == ([edits] if edits <= budget else [])
