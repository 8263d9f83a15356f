"""Hard negatives by cover trees over norm-augmented vectors.

Vectors of integers are extended by one component to the same length, so that
for any query the inner product falls with the angle. Rows are ordered by
cell (the nearest of some pivots) and label and dealt to tasks by ranges of
that order; each task builds cover trees of bounded blocks: a node's centre is
one of its rows, its covering radius the largest angle to them, and its
children have centres that cover it at half that radius and are farther apart
than it. A query's angle to a centre, less or plus the radius, bounds its
inner products with all rows of the node, so nodes outside the query's window
of scores, or below its worst kept one, are skipped; the others are opened best
first, many queries at a time, and their rows are scored exactly, in integers.

A query first meets the trees of its own row's task, and then, with the score
that it has reached, those of all others. Trees travel to tasks once, the query
set is streamed past them, and each task returns at most k rows a query.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import python_batches, table, written

#: Scale of components, positives of an anchor, negatives of a positive.
SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: Pivots that order the rows, a bounded sample; they have no effect on results.
PIVOTS = 64
#: Rows of a tree, and rows below which a node is not divided.
BLOCK, LEAF = 2048, 12
#: Queries that meet a tree at once.
AT_ONCE = 512
NONE = np.iinfo(np.int64).min
INDEX = "part int, block int, tree binary, mine array<struct<row:bigint,vec_id:bigint,label:int,v:binary>>"
FOUND = "q long, score long, vec_id long, row long"


def vectors(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """Rows (row, vec_id, label, v) that take part, and the components of the longest.

    Rows with a null label or vector or a component that is null or not finite
    take no part; nor do those with a component so large that inner products
    don't fit 64 bits. Shorter vectors count as filled up with zeros. `row` is
    a number of the row, so that rows of equal or null vec_id are told apart.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = embeddings.where("label is not null and embedding is not null").where(~F.exists("embedding", lambda x: bad(x.cast("double"))))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), scaled.alias("v"))
    width = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    most = int((2**62 / width) ** 0.5)
    rows = rows.where(~F.exists("v", lambda x: F.abs(x) > most))
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors"), width


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column, filled up with zeros."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), width), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(size)), size), at] = flat
    return out


def _celled(batches: Iterator[pa.RecordBatch], width: int, pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds the nearest pivot and turns vectors into bytes."""
    for batch in batches:
        v = _matrix(batch.column("v"), width)
        cell = np.argmax(v @ pivots.T, axis=1) if len(pivots) else np.zeros(len(v))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), batch.column("label"), pa.array(cell.astype(np.int32)), pa.array([x.tobytes() for x in v], pa.binary())], names=["row", "vec_id", "label", "cell", "v"])


def grown(v: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """A cover tree of some vectors: per node its centre, radius, children (first, last), rows (start, end in `order`), labels (low, high), and whether its centre isn't its parent's."""
    x = v.astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    longest = max(float(norm.max()), 1.0)
    y = np.column_stack([x, np.sqrt(np.maximum(longest**2 - norm**2, 0))]) / longest
    angle = np.arccos(np.clip(y @ y.T, -1, 1))
    np.fill_diagonal(angle, 0)
    centre, fresh, groups = [int(np.argmin(angle.max(axis=1)))], [True], [np.arange(len(v))]
    radius, first, last, start, end, order = [], [], [], [], [], []
    at = placed = 0
    while at < len(centre):
        c, rows = centre[at], groups[at]
        radius.append(float(angle[c, rows].max()))
        first.append(len(centre))
        start.append(placed)
        if len(rows) > LEAF and radius[-1] > 1e-7:
            rest, head = rows, c
            while len(rest):
                near = angle[head, rest] <= radius[-1] / 2
                centre.append(head)
                fresh.append(head != c)
                groups.append(rest[near])
                rest = rest[~near]
                head = int(rest[0]) if len(rest) else -1
        else:
            order.append(rows[rows != c])
            placed += len(order[-1])
        last.append(len(centre))
        end.append(placed)
        at += 1
    ints = {"centre": centre, "first": first, "last": last, "start": start, "end": end, "low": [int(label[g].min()) for g in groups], "high": [int(label[g].max()) for g in groups]}
    return {**{k: np.array(a, np.int64) for k, a in ints.items()}, "radius": np.array(radius), "fresh": np.array(fresh), "order": np.concatenate(order), "longest": np.array([longest])}


def _planted(batches: Iterator[pa.RecordBatch], width: int, anchors: int) -> Iterator[pa.RecordBatch]:
    """Cover trees of the task's rows, with those rows that are anchors."""
    part, block = TaskContext.get().partitionId(), 0
    held: list[pa.RecordBatch] = []
    names = ["row", "vec_id", "label", "v"]

    def tree(rows: pa.Table) -> pa.RecordBatch:
        ids = rows.column("vec_id").combine_chunks()
        v = np.frombuffer(b"".join(rows.column("v").to_pylist()), np.int64).reshape(-1, width)
        label = rows.column("label").to_numpy()
        file = io.BytesIO()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        vec_id = ids.fill_null(0).to_numpy()
        np.savez(file, v=v, label=label, vec_id=vec_id, known=known, row=rows.column("row").to_numpy(), **grown(v, label))
        mine = rows.filter(pa.array(known & (vec_id % anchors == 0))).select(names).to_pylist()
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([file.getvalue()], pa.binary()), pa.array([mine], pa.list_(pa.struct([("row", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int32()), ("v", pa.binary())])))], names=["part", "block", "tree", "mine"])

    def joined() -> pa.Table:
        return pa.Table.from_batches(held).select(names)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        while sum(b.num_rows for b in held) >= BLOCK:
            rows = joined()
            yield tree(rows.slice(0, BLOCK))
            block += 1
            held = rows.slice(BLOCK).to_batches()
    if held and sum(b.num_rows for b in held):
        yield tree(joined())


class Kept:
    """The best rows of each query so far: higher scores first, then smaller ids (none: last), then row numbers."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), NONE)
        self.unknown, self.vec_id, self.row = np.ones((n, k), bool), np.zeros((n, k), np.int64), np.full((n, k), -1)

    def add(self, queries: np.ndarray, score: np.ndarray, fits: np.ndarray, known: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        """Scores (a row for each query) of rows that fit where `fits` says so."""
        k = self.score.shape[1]
        score = np.where(fits, score, NONE)
        some = np.flatnonzero((score > NONE).any(axis=1) & (score.max(axis=1) >= self.score[queries, -1]))
        if not len(some):
            return
        queries, score = queries[some], score[some]
        if score.shape[1] > 8 * k:  # only those from the k-th score on, ties included
            floor = np.maximum(np.partition(score, -k, axis=1)[:, -k], self.score[queries, -1])
            at = np.flatnonzero(((score >= floor[:, None]) & (score > NONE)).any(axis=0))
            score, known, vec_id, row = score[:, at], known[at], vec_id[at], row[at]
        wide = lambda x: np.broadcast_to(x, score.shape)
        s = np.concatenate([self.score[queries], score], axis=1)
        u = np.concatenate([self.unknown[queries], wide(~known)], axis=1)
        i = np.concatenate([self.vec_id[queries], wide(vec_id)], axis=1)
        r = np.concatenate([self.row[queries], wide(row)], axis=1)
        best = np.lexsort((r, i, u, -np.maximum(s, -np.iinfo(np.int64).max)), axis=1)[:, :k]
        pick = lambda x: np.take_along_axis(x, best, axis=1)
        self.score[queries], self.unknown[queries], self.vec_id[queries], self.row[queries] = pick(s), pick(u), pick(i), pick(r)


def descend(t: dict[str, np.ndarray], v: np.ndarray, label: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, kept: Kept, lo: int) -> None:
    """Takes the tree's best rows for queries lo, lo + 1, ... of `kept` into it; scores are within [low, high]."""
    n, longest = len(v), float(t["longest"][0])
    norm = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
    size = max(int(np.abs(t["v"]).max(initial=0)), 1) * max(int(np.abs(v).max(initial=0)), 1) * v.shape[1]
    exact = np.float64 if size < 1 << 53 else np.int64
    mine, theirs = v.astype(exact), t["v"].astype(exact)
    big, slack = norm * longest, norm * longest * 1e-6 + 1e-6
    inner = t["last"] > t["first"]
    more = inner | (t["end"] > t["start"])  # nodes with rows besides their centre
    waiting = np.full((n, len(more)), -np.inf)
    everyone = np.arange(n)

    def score(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        s = mine[q] @ theirs[rows].T
        s = np.rint(s).astype(np.int64) if exact is np.float64 else s
        fits = (label[q][:, None] == t["label"][rows]) == same
        fits &= (own[q][:, None] != t["row"][rows]) & (s >= low[q][:, None]) & (s <= high[q][:, None])
        kept.add(q + lo, s, fits, t["known"][rows], t["vec_id"][rows], t["row"][rows])
        return s

    def offer(q: np.ndarray, nodes: np.ndarray, s: np.ndarray) -> None:
        """Puts nodes with these scores of their centres on the queries' lists, unless they lie outside the windows."""
        away = np.arccos(np.clip(s / np.maximum(big[q], 1e-300)[:, None], -1, 1))
        upper = big[q][:, None] * np.cos(np.maximum(away - t["radius"][nodes], 0)) + slack[q][:, None]
        lower = big[q][:, None] * np.cos(np.minimum(away + t["radius"][nodes], np.pi)) - slack[q][:, None]
        of = label[q][:, None]
        may = (t["low"][nodes] <= of) & (t["high"][nodes] >= of) if same else (t["low"][nodes] != of) | (t["high"][nodes] != of)
        may &= (lower <= high[q][:, None]) & (upper >= low[q][:, None]) & more[nodes]
        waiting[np.ix_(q, nodes)] = np.where(may, np.minimum(upper, high[q][:, None] + 1.0), -np.inf)

    root = np.zeros(1, np.int64)
    offer(everyone, root, score(everyone, t["centre"][root]))
    active = everyone
    while len(active):
        best = waiting[active].argmax(axis=1)
        bound = waiting[active, best]
        least = np.maximum(kept.score[active + lo, -1], low[active])
        going = (bound > -np.inf) & (bound >= least)
        active, best = active[going], best[going]
        waiting[active, best] = -np.inf
        for node in np.unique(best):
            q = active[best == node]
            if inner[node]:
                nodes = np.arange(t["first"][node], t["last"][node])
                old, new = nodes[~t["fresh"][nodes]], nodes[t["fresh"][nodes]]
                if len(new):
                    offer(q, new, score(q, t["centre"][new]))
                if len(old):  # the node's own centre, scored before
                    s = mine[q] @ theirs[t["centre"][old]].T
                    offer(q, old, s)
            else:
                score(q, t["order"][t["start"][node] : t["end"][node]])


def _searched(batches: Iterator[pa.RecordBatch], k: int, same: bool, width: int) -> Iterator[pa.RecordBatch]:
    """Rows of one part: first its trees, then queries, which are answered as they come."""
    part, trees = None, []
    for batch in batches:
        parts, tree = batch.column("part").to_numpy(), batch.column("tree")
        has = tree.is_valid().to_numpy(zero_copy_only=False)
        at = 0
        while at < len(parts):
            if parts[at] != part:
                part, trees = parts[at], []
            if has[at]:
                with np.load(io.BytesIO(tree[at].as_py())) as f:
                    trees.append({name: f[name] for name in f.files})
                at += 1
                continue
            to = at
            while to < len(parts) and to - at < AT_ONCE and parts[to] == part and not has[to]:
                to += 1
            some = batch.slice(at, to - at)
            at = to
            if not trees:
                continue
            get = lambda c: some.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            v = np.frombuffer(b"".join(some.column("v").to_pylist()), np.int64).reshape(-1, width)
            kept = Kept(len(v), k)
            for t in trees:
                descend(t, v, get("label"), get("row"), get("low"), get("high"), same, kept, 0)
            q, place = np.nonzero(kept.score > NONE)
            ids = pa.array(kept.vec_id[q, place], mask=kept.unknown[q, place])
            yield pa.RecordBatch.from_arrays([pa.array(get("q")[q]), pa.array(kept.score[q, place]), ids, pa.array(kept.row[q, place])], names=["q", "score", "vec_id", "row"])


class CoverTrees:
    """Cover trees of all rows of a table of vectors, written in the shared folder."""

    def __init__(self, embeddings: DataFrame, anchors: int):
        self.spark = embeddings.sparkSession
        rows, self.width = vectors(embeddings)
        sample = rows.orderBy(F.xxhash64("row")).limit(PIVOTS).select("v").toArrow().column("v").combine_chunks()
        pivots = _matrix(sample, self.width).astype(np.float64)
        pivots /= np.maximum(np.sqrt((pivots**2).sum(axis=1)), 1)[:, None]
        celled = rows.mapInArrow(partial(_celled, width=self.width, pivots=pivots), "row long, vec_id long, label int, cell int, v binary")
        by = ("cell", "label", "row")
        self.index = written(celled.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(partial(_planted, width=self.width, anchors=anchors), INDEX), "trees")
        self.parts = (self.index.agg(F.max("part")).first()[0] or 0) + 1

    def anchors(self) -> DataFrame:
        """The rows whose id the given number divides, with the part that holds them."""
        return self.index.select("part", F.inline("mine"))

    def nearest(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """The k best rows of each query: q, score, vec_id, row, rank.

        Queries have q, part, row, label, v, low and high; rows of the same
        label (another one, if not `same`) but not the query's own row are
        taken whose score is within low and high.
        """
        queries = queries.select("q", "part", "row", "label", "v", "low", "high")
        home = written(self._met(queries, k, same), "home")
        worst = home.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst")).where(F.col("n") >= k).select("q", "worst")
        others = queries.join(worst, "q", "left").withColumn("low", F.greatest("low", "worst")).drop("worst")
        others = others.withColumn("home", F.col("part")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1)))).where("part <> home").drop("home")
        found = home.unionByName(self._met(others, k, same))
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def _met(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        asked = queries.withColumns({"part": F.col("part").cast("int"), "tree": F.lit(None).cast("binary"), "kind": F.lit(1)})
        trees = self.index.select("part", "tree", F.lit(0).alias("kind"))
        rows = trees.unionByName(asked, allowMissingColumns=True).repartition("part").sortWithinPartitions("part", "kind")
        return rows.drop("kind").mapInArrow(partial(_searched, k=k, same=same, width=self.width), FOUND)


def mined(embeddings: DataFrame, anchors: int, positives: int = POSITIVES, negatives: int = NEGATIVES, floor: Column | None = None) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each row whose vec_id the number `anchors` divides, and each of its best
    rows of the same label, the best rows of other labels that score no more
    than that and no less than `floor` of positive_score (four fifths of it).
    """
    spark = embeddings.sparkSession
    ends = [F.lit(v).cast("long") for v in (NONE + 1, np.iinfo(np.int64).max)]
    with python_batches(spark, AT_ONCE):
        trees = CoverTrees(embeddings, anchors)
        asked = written(trees.anchors().select(F.monotonically_increasing_id().alias("q"), "*", ends[0].alias("low"), ends[1].alias("high")), "anchors")
        best = trees.nearest(asked, positives, True).select("q", F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id"), F.col("row").alias("positive_row"))
        floor = F.col("positive_score") - F.floor(F.col("positive_score") / F.lit(5)) if floor is None else floor
        pairs = asked.drop("low", "high").join(best, "q").where("positive_score >= 0")
        pairs = pairs.withColumns({"q": F.monotonically_increasing_id(), "anchor_id": F.col("vec_id"), "low": floor.cast("long"), "high": F.col("positive_score")})
        pairs = written(pairs.drop("vec_id"), "pairs")
        found = trees.nearest(pairs, negatives, False).select("q", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        return written(pairs.select("q", "anchor_id", "positive_id", "positive_score").join(found, "q").select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score"), "negatives")


def op12_cover_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all anchors of the embeddings, some of whose labels are changed first.

    Repeated rows are rows of their own; a null vec_id is no anchor and comes
    after all ids of its score. An empty table gives an empty result. Other
    columns aren't read.
    """
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")), 100)


ORACLE = """
WITH c AS (
  SELECT vec_id, row_number() OVER () AS row, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
w AS (SELECT greatest(1, max(len(v))) AS w FROM c),
r AS (SELECT vec_id, row, label, list_resize(v, w.w, 0) AS v FROM c, w WHERE coalesce(list_max(list_transform(v, lambda x: abs(x))), 0) <= floor(sqrt(4611686018427387904.0 / w.w))),
s AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, a.label = b.label AS same, b.row, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.row <> b.row WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor, anchor_id, row AS positive, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, row) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.vec_id NULLS LAST, s.row)::INTEGER AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.vec_id NULLS LAST, s.row) <= 5
"""
