"""A z-fast trie of conversations that share their first turns.

A conversation is a string of turns. Of the trie of all strings only the
compacted nodes are kept: the root, ends of strings and forks. A node covers
the depths from below its parent to its own length; its handle is the prefix
whose length in that range has the most trailing zero bits (2-fattest), and the
nodes form a table by the hash of their handle. The node at which a string
leaves the trie is found by fat binary search: each round asks that table for
one prefix of every string, so the rounds grow with the logarithm of the
longest string. Strings come in batches: only what lies below their exits, and
the edges that they leave, are opened into single depths, grouped, and
compacted again. Subtree sums are taken over the compacted nodes by pointer
doubling, and edges are expanded into their depths at the very end.

Prefixes are told apart by 128 bits: the exclusive or of a hash of each turn
and its depth. Such prefix hashes are taken over ranges of the ordered turns,
and what a range inherits is added after, so a conversation may be larger than
a task. Nothing is collected but the counts that end the loops.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import python_batches, shared_dir, table, written
from loomgraph.llm.suffix_family import having
from loomgraph.llm.textcodes import INVERSE, ODD, mix

#: Batches in which the query inserts its conversations.
BATCHES = 2
#: The dealt rebuilding: conversations of one base, and lengths of what they take from it.
SIBLINGS, HEADS = 5, 9
NUMBERED = "conv_id long, symbol binary, size long, part int, place long"
PREFIXES = "conv_id long, depth long, hi long, lo long, phi long, plo long, size long, total long, part int"
NODE = "hi long, lo long, length long, total long, up long, witness long, handle long, hhi long, hlo long, ehi long, elo long, phi long, plo long, above long"
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


def symbol(role: Column, text: Column) -> Column:
    """128 bits of a turn."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def _runs(conv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal ids begin, and the run of each row."""
    new = np.ones(len(conv), bool)
    new[1:] = conv[1:] != conv[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of each conversation within the task, from 1."""
    part, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_numpy(zero_copy_only=False)
        first, run = _runs(conv)
        place = np.arange(len(conv)) - first[run] + 1
        if conv[0] == last:
            place[run == 0] += count
        last, count = conv[-1], int(place[-1])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("symbol"), batch.column("size"), pa.array(np.full(len(conv), part, np.int32)), pa.array(place)], names=["conv_id", "symbol", "size", "part", "place"])


def _prefixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix hashes and sizes of each conversation within the task; those of earlier tasks are added later."""
    part, last, held = TaskContext.get().partitionId(), None, (np.uint64(0), np.uint64(0), 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_numpy(zero_copy_only=False)
        depth = batch.column("depth").to_numpy(zero_copy_only=False).astype(np.uint64)
        size = batch.column("size").to_numpy(zero_copy_only=False)
        half = np.frombuffer(b"".join(batch.column("symbol").to_pylist()), np.uint64).reshape(-1, 2)
        first, run = _runs(conv)
        out = []
        for k, by in ((0, ODD), (1, INVERSE)):
            whole = np.bitwise_xor.accumulate(mix(mix(half[:, k] ^ np.uint64(k + 1)) + depth * by))
            before = np.concatenate([[np.uint64(0)], whole[:-1]])
            here, above = whole ^ before[first][run], before ^ before[first][run]
            if conv[0] == last:
                here[run == 0] ^= held[k]
                above[run == 0] ^= held[k]
            out += [here, above]
        sums = np.cumsum(size)
        total = sums - (sums - size)[first][run]
        if conv[0] == last:
            total[run == 0] += held[2]
        last, held = conv[-1], (out[0][-1], out[2][-1], int(total[-1]))
        columns = [batch.column("conv_id"), batch.column("depth"), *(pa.array(out[i].view(np.int64)) for i in (0, 2, 1, 3)), batch.column("size"), pa.array(total), pa.array(np.full(len(conv), part, np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "depth", "hi", "lo", "phi", "plo", "size", "total", "part"])


def _ordered(rows: DataFrame, *by: str | Column) -> DataFrame:
    return rows.repartitionByRange(*by).sortWithinPartitions(*by)


def _inherited(rows: DataFrame, **sums: Column) -> DataFrame:
    """Per task and conversation that began in an earlier task, the given aggregates over the earlier ones: one row a task at most."""
    parts = rows.groupBy("conv_id", "part").agg(*[c.alias(n) for n, c in sums.items()])
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda n: F.bit_xor(n) if n in ("hi", "lo") else F.sum(n)
    return parts.select("conv_id", "part", *[total(n).over(before).alias(f"{n}_") for n in sums], F.row_number().over(Window.partitionBy("conv_id").orderBy("part")).alias("r_")).where("r_ > 1").drop("r_")


def numbered(turns: DataFrame, *order: str | Column) -> DataFrame:
    """Rows (conv_id, symbol, size) with their place in the conversation, from 1; order begins with conv_id."""
    rows = written(_ordered(turns, *order).select("conv_id", "symbol", "size").mapInArrow(_placed, NUMBERED), "placed")
    earlier = _inherited(rows, place=F.max("place"))
    return rows.join(F.broadcast(earlier), ["conv_id", "part"], "left").select("conv_id", "symbol", "size", (F.col("place") + F.coalesce("place_", F.lit(0))).alias("place"))


def prefixes(turns: DataFrame) -> DataFrame:
    """Steps of conversations from rows (conv_id, depth, symbol, size): conv_id, depth, the prefix's hash (hi, lo) and that of the one above (phi, plo), size, total."""
    rows = written(_ordered(turns, "conv_id", "depth").mapInArrow(_prefixed, PREFIXES), "prefixes")
    last = lambda c: F.max_by(c, "depth")
    earlier = _inherited(rows, hi=last("hi"), lo=last("lo"), total=F.max("total"))
    rows = rows.join(F.broadcast(earlier), ["conv_id", "part"], "left")
    add = lambda c, other: F.col(c).bitwiseXOR(F.coalesce(other, F.lit(0))).alias(c)
    return rows.select("conv_id", "depth", add("hi", "hi_"), add("lo", "lo_"), add("phi", "hi_"), add("plo", "lo_"), "size", (F.col("total") + F.coalesce("total_", F.lit(0))).alias("total"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversation ids (conv_id), and the turns (conv_id, depth, symbol, size) of the rebuilt conversations.

    Turns are ordered by turn (null first), equal ones by the MD5 of role and
    text. Rows without a conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", F.unhex(symbol(role, text)).alias("symbol"), F.octet_length(text).cast("long").alias("size"))
    mine = written(numbered(turns, "conv_id", F.col("turn").asc_nulls_first(), "symbol"), "turns")
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    base = F.col("conv_id") - F.col("conv_id") % SIBLINGS
    ids = mine.select("conv_id").distinct()
    taken = mine.where(F.col("place") < HEADS).select(F.col("conv_id").alias("base"), "symbol", "size", "place")
    heads = ids.withColumn("base", base).withColumn("head", head).join(taken, "base").where("place <= head")
    rows = heads.select("conv_id", "symbol", "size", "place").unionByName(mine.where(F.col("place") > head))
    return ids, numbered(rows, "conv_id", "place").withColumnRenamed("place", "depth")


class ZFastTrie:
    """A z-fast trie in a folder; each batch's steps and ends are added to it, and a new table of nodes replaces the old one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.steps_in: list[str] = []
        self.ends_in: list[str] = []
        self.nodes_in: str | None = None

    def _save(self, df: DataFrame, kind: str) -> str:
        folder = f"{self.root}/{kind}/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return folder

    def steps(self) -> DataFrame:
        return self.spark.read.parquet(*self.steps_in)

    def ends(self) -> DataFrame:
        """conv_id, length, hi, lo: where each conversation ends."""
        return self.spark.read.parquet(*self.ends_in)

    def nodes(self) -> DataFrame:
        """All compacted nodes but the root."""
        return self.spark.read.schema(NODE).parquet(self.nodes_in) if self.nodes_in else self.spark.createDataFrame([], NODE)

    def _at(self, rows: DataFrame, conv: str, depth: str, how: str = "inner", **columns: str) -> DataFrame:
        """Adds columns of the step of one conversation and depth; no two steps share both, so no key is hot."""
        steps = self.steps().select(F.col("conv_id").alias(conv), F.col("depth").alias(depth), *[F.col(c).alias(n) for n, c in columns.items()])
        return rows.join(steps, [conv, depth], how)

    def locate(self, strings: DataFrame) -> DataFrame:
        """Where each string (witness, length) leaves the trie: at, the length of its deepest node, and edge, that node's child whose edge the string enters.

        Fat binary search over the lengths from a to b: the 2-fattest of them
        is looked up among the handles. A node whose whole extent is met moves
        a to its length; one that is met in its handle only is the exit; none
        moves b below the handle.
        """
        state, done = strings.select("witness", "length", F.lit(0).cast("long").alias("a"), F.col("length").alias("b")), []
        handles = self.nodes().select(F.col("hhi").alias("khi"), F.col("hlo").alias("klo"), F.col("length").alias("g"), "up", F.col("hi").alias("ghi"), F.col("lo").alias("glo"), F.lit(True).alias("met"))
        while True:
            state = written(state, "search")
            done.append(state.where("a >= b").select("witness", "length", "a"))
            state = state.where("a < b").withColumn("f", F.expr("b & shiftleft(-1L, length(bin(a ^ b)) - 1)"))
            if state.isEmpty():
                break
            state = self._at(state, "witness", "f", khi="hi", klo="lo").join(handles, ["khi", "klo"], "left")
            state = self._at(state.withColumn("g_", F.least("g", "length")), "witness", "g_", "left", xhi="hi", xlo="lo")
            whole = F.coalesce((F.col("g") <= F.col("length")) & (F.col("xhi") == F.col("ghi")) & (F.col("xlo") == F.col("glo")), F.lit(False))
            met = F.col("met").isNotNull()
            a = F.when(whole, F.col("g")).when(met, F.col("up")).otherwise(F.col("a"))
            b = F.when(whole, F.greatest("b", "g")).when(met, F.col("up")).otherwise(F.col("f") - 1)
            state = state.select("witness", "length", a.alias("a"), b.alias("b"))
        found = reduce(DataFrame.unionByName, done)
        edges = self.nodes().select(F.col("ehi").alias("nhi"), F.col("elo").alias("nlo"), F.struct("hi", "lo", "length", "up", "witness").alias("edge"))
        below = self._at(found.withColumn("next", F.col("a") + 1), "witness", "next", "left", nhi="hi", nlo="lo")
        return below.join(edges, ["nhi", "nlo"], "left").select("witness", "length", F.col("a").alias("at"), "edge")

    def insert(self, ids: DataFrame, turns: DataFrame) -> None:
        """Adds conversations that the trie doesn't hold: their ids, and their turns (conv_id, depth, symbol, size)."""
        steps = self._save(prefixes(turns), "steps")
        self.steps_in.append(steps)
        mine = self.spark.read.parquet(steps)
        last = mine.groupBy("conv_id").agg(F.max("depth").alias("length"), F.max_by("hi", "depth").alias("hi"), F.max_by("lo", "depth").alias("lo"))
        zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("length", "hi", "lo")]
        self.ends_in.append(self._save(ids.select("conv_id").join(last, "conv_id", "left").select("conv_id", *zero), "ends"))
        # Equal conversations are one string.
        strings = self.spark.read.parquet(self.ends_in[-1]).where("length > 0").groupBy("hi", "lo", "length").agg(F.min("conv_id").alias("witness"))
        if self.nodes_in:
            strings = written(strings, "strings")
            found = written(self.locate(strings), "exits")
        else:
            found = written(strings.select("witness", "length", F.lit(0).cast("long").alias("at"), F.lit(None).cast("struct<hi:long,lo:long,length:long,up:long,witness:long>").alias("edge")), "exits")
        out = found.where("at < length")
        opened = out.where("edge is not null").select("edge.*").distinct()
        fields = ["hi", "lo", "phi", "plo", "depth", "total", F.col("conv_id").alias("witness")]
        tails = mine.join(out.select(F.col("witness").alias("conv_id"), F.col("at").alias("base")), "conv_id").where("depth > base").select(*fields, "base")
        spans = opened.select(F.col("witness").alias("conv_id"), F.col("up").alias("base"), F.explode(F.sequence(F.col("up") + 1, F.col("length"))).alias("depth"))
        region = written(tails.unionByName(spans.join(self.steps(), ["conv_id", "depth"]).select(*fields, "base")), "region")
        keys = written(region.groupBy("hi", "lo").agg(F.min("phi").alias("phi"), F.min("plo").alias("plo"), F.min("depth").alias("length"), F.min("total").alias("total"), F.min("witness").alias("witness"), F.count(F.lit(1)).alias("n")), "keys")
        forks = keys.groupBy(F.col("phi").alias("hi"), F.col("plo").alias("lo")).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("hi", "lo")
        stops = mine.select("conv_id", "depth", "hi", "lo").join(out.select(F.col("witness").alias("conv_id"), F.col("length").alias("depth")), ["conv_id", "depth"]).select("hi", "lo")
        kept = forks.unionByName(stops).unionByName(opened.select("hi", "lo")).distinct()
        made = written(keys.join(kept, ["hi", "lo"], "left_semi").select("hi", "lo", "length", "total", "witness", "n"), "made")
        along = Window.partitionBy("witness", "base").orderBy("depth")
        path = having(region, made.select("hi", "lo", "n"), ["hi", "lo"]).withColumn("up", F.coalesce(F.lag("depth").over(along), F.col("base")))
        placed = path.groupBy("hi", "lo").agg(F.max("up").alias("up")).join(made.drop("n"), ["hi", "lo"])
        placed = placed.withColumns({"handle": F.expr("length & shiftleft(-1L, length(bin(up ^ length)) - 1)"), "next": F.col("up") + 1})
        placed = self._at(self._at(placed, "witness", "handle", hhi="hi", hlo="lo"), "witness", "next", ehi="hi", elo="lo", phi="phi", plo="plo", t_="total", s_="size")
        columns = NODE.replace(" long", "").split(", ")
        fresh = written(placed.withColumn("above", F.col("t_") - F.col("s_")).select(*columns), "fresh")
        self.nodes_in = self._save(self.nodes().join(fresh.select("hi", "lo"), ["hi", "lo"], "left_anti").unionByName(fresh), "nodes")


def subtree(nodes: DataFrame, **columns: Column) -> DataFrame:
    """Sums (of columns called least: minima) over the subtree of each node (hi, lo; phi, plo: its parent, null for the root).

    Pointer doubling: in round k each node adds its sums to the ancestor 2^k
    above it, combined before the shuffle, and then looks twice as far.
    """
    names = list(columns)
    both = lambda n: F.min if n == "least" else F.sum
    state = written(nodes.select("hi", "lo", F.col("phi").alias("jhi"), F.col("plo").alias("jlo"), *[c.alias(n) for n, c in columns.items()]), "subtree")
    while not (far := state.where("jhi is not null")).isEmpty():
        more = far.groupBy(F.col("jhi").alias("hi"), F.col("jlo").alias("lo")).agg(*[both(n)(n).alias(f"{n}_") for n in names])
        add = lambda n: F.least(n, f"{n}_") if n == "least" else F.col(n) + F.coalesce(f"{n}_", F.lit(0))
        sums = state.join(more, ["hi", "lo"], "left").select("hi", "lo", "jhi", "jlo", *[add(n).alias(n) for n in names])
        jumps = state.where("jhi is not null").select(F.col("hi").alias("jhi"), F.col("lo").alias("jlo"), F.col("jhi").alias("far_hi"), F.col("jlo").alias("far_lo"))
        state = written(sums.join(jumps, ["jhi", "jlo"], "left").select("hi", "lo", F.col("far_hi").alias("jhi"), F.col("far_lo").alias("jlo"), *names), "subtree")
    return state.select("hi", "lo", *names)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows (hi, lo, conv_id) of one node, each as one text of its ids."""
    for batch in batches:
        hi, lo, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("hi", "lo", "conv_id"))
        if not len(hi):
            continue
        at = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
        texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(at, [*at[1:], len(hi)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(hi[at]), pa.array(lo[at]), pa.array(ids[at]), pa.array(texts)], names=["hi", "lo", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's runs, in order; only one run is held."""
    node, state = None, None
    for batch in batches:
        out = []
        for hi, lo, ids in zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "ids")), strict=True):
            if (hi, lo) == node:
                state.update(b"," + ids.encode())
            else:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (hi, lo), hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["hi", "lo", "ends_sha256"])
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, state.hexdigest())], names=["hi", "lo", "ends_sha256"])


def expanded(trie: ZFastTrie) -> DataFrame:
    """One row for each depth of each edge, and the root: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ends = trie.ends()
    runs = _ordered(ends.select("hi", "lo", "conv_id"), "hi", "lo", "conv_id").mapInArrow(_joined, "hi long, lo long, first long, ids string")
    by = ("hi", "lo", "first")
    digests = written(runs.repartition("hi", "lo").sortWithinPartitions(*by).mapInArrow(_hashed, "hi long, lo long, ends_sha256 string"), "digests")
    root = trie.spark.range(1).select(F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"), *[F.lit(None).cast("long").alias(c) for c in ("phi", "plo")], *[F.lit(0).cast("long").alias(c) for c in ("length", "total", "up", "above")], F.lit(None).cast("long").alias("witness"))
    nodes = trie.nodes().select(*root.columns).unionByName(root)
    own = ends.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n_own"), F.min("conv_id").alias("first"))
    children = trie.nodes().groupBy(F.col("phi").alias("hi"), F.col("plo").alias("lo")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(own, ["hi", "lo"], "left").join(children, ["hi", "lo"], "left").join(digests, ["hi", "lo"], "left").fillna(0, ["n_own", "n_children"]), "nodes")
    counts = subtree(nodes, n_convs=F.col("n_own"), least=F.col("first"), n_leaves=(F.col("n_children") == 0).cast("long"))
    nodes = written(nodes.drop("first").join(counts, ["hi", "lo"]), "counted")
    sums = subtree(nodes, saved=(F.col("n_convs") - 1) * (F.col("total") - F.col("above")))
    above = nodes.select(F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("least").alias("above_id"))
    nodes = nodes.join(sums, ["hi", "lo"]).join(above, ["phi", "plo"], "left")
    values = ["least", "above_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256", "length", "up", "above"]
    edges = nodes.where("length > 0").select(F.col("witness").alias("conv"), F.explode(F.sequence(F.col("up") + 1, F.col("length"))).alias("depth"), *values)
    steps = trie.steps().select(F.col("conv_id").alias("conv"), "depth", (F.col("total") - F.col("size")).alias("before"))
    rows = edges.join(steps, ["conv", "depth"]).unionByName(nodes.where("length = 0 and n_convs > 0").select(F.lit(0).cast("long").alias("depth"), *values, F.lit(None).cast("long").alias("conv"), F.lit(0).cast("long").alias("before")))
    end = F.col("depth") == F.col("length")
    return rows.select(
        F.col("least").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == F.col("up") + 1, F.col("above_id")).otherwise(F.col("least")).cast("long").alias("parent_conv_id"),
        "n_convs",
        F.when(end, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("saved") - (F.col("n_convs") - 1) * (F.col("before") - F.col("above"))).alias("saved_tokens"),
        F.when(end, F.coalesce("ends_sha256", F.lit(EMPTY_HASH))).otherwise(F.lit(EMPTY_HASH)).alias("ends_sha256"),
    )


def trie_of(ids: DataFrame, turns: DataFrame, batches: int = BATCHES) -> ZFastTrie:
    """A new trie in the shared folder, filled in so many batches, by a hash of the id."""
    spark = ids.sparkSession
    trie = ZFastTrie(spark, f"{shared_dir(spark).rstrip('/')}/loomgraph/trie-{uuid.uuid4().hex}")
    with python_batches(spark, 10_000):
        for b in range(batches):
            some = F.pmod(F.xxhash64("conv_id"), F.lit(batches)) == b
            trie.insert(ids.where(some), turns.where(some))
    return trie


def op11_zfast_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations.

    Null roles and texts are empty; equal turns are ordered by the MD5 of role
    and text; repeated rows are further turns; rows without a conv_id are left
    out. An empty table gives an empty result. Other columns aren't read.
    """
    with python_batches(spark, 10_000):
        ids, turns = rebuilt(table(spark, sf_dir, "conversations"))
        trie = trie_of(written(ids, "ids"), written(turns, "rebuilt"))
        return written(expanded(trie), "expanded")


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
),
bits AS (SELECT range AS i, range::UINTEGER AS c FROM range(256)),
crc8 AS (
  SELECT i, c, 0 AS k FROM bits
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END, k + 1 FROM crc8 WHERE k < 8
),
crct AS (SELECT list(c ORDER BY i) AS tab FROM crc8 WHERE k = 8),
ids AS (SELECT DISTINCT conv_id FROM t),
crc AS (
  SELECT conv_id, conv_id::VARCHAR AS s, 0 AS k, 4294967295::UINTEGER AS c FROM ids
  UNION ALL SELECT conv_id, s, k + 1, xor(c >> 8, list_extract((SELECT tab FROM crct), (xor(c, ascii(s[k + 1])::UINTEGER) & 255)::BIGINT + 1)) FROM crc WHERE k < length(s)
),
heads AS (SELECT conv_id, (xor(c, 4294967295::UINTEGER) % 9)::BIGINT AS h, conv_id - conv_id % 5 AS base FROM crc WHERE k = length(s)),
parts AS (
  SELECT heads.conv_id, pos, role, text FROM heads JOIN t ON t.conv_id = heads.base AND pos <= h
  UNION ALL SELECT heads.conv_id, pos, role, text FROM heads JOIN t ON t.conv_id = heads.conv_id AND pos > h
),
coded AS (SELECT conv_id, pos, strlen(text) AS bytes, dense_rank() OVER (ORDER BY role, text) AS code FROM parts),
seqs AS (SELECT ids.conv_id, coalesce(list(code ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS seq, coalesce(list(bytes ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS bytes FROM ids LEFT JOIN coded ON ids.conv_id = coded.conv_id GROUP BY ids.conv_id),
steps AS (SELECT conv_id, unnest(range(0, len(seq) + 1)) AS depth, seq, bytes FROM seqs),
nodes AS (
  SELECT list_slice(seq, 1, depth) AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(CASE WHEN depth > 0 THEN list_extract(bytes, depth) ELSE 0 END) AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(seq) = depth), '')) AS ends_sha256
  FROM steps GROUP BY ALL
),
kids AS (SELECT list_slice(node, 1, depth - 1) AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids ON nodes.node = kids.node AND nodes.depth = kids.depth),
above AS (SELECT list_slice(node, 1, d) AS node, d, n_convs, bytes, n_children FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_nodes)),
sums AS (SELECT node, d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM above GROUP BY ALL)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums s ON f.node = s.node AND f.depth = s.d LEFT JOIN full_nodes p ON f.depth > 0 AND p.depth = f.depth - 1 AND p.node = list_slice(f.node, 1, f.depth - 1)
"""
