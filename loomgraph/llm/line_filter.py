"""Line dedup with a once-seen and a twice-seen Bloom filter.

A line's key is the line without ASCII white space at its ends, A-Z in lower
case. Tasks hash the keys of their documents and deal the 64-bit hashes, 8
bytes each, to segments of the hash range. A segment holds two Bloom filters:
a hash that the once-seen filter knows already enters the twice-seen one. Only
hashes that the twice-seen filter holds go on, the keys behind them alone are
shuffled as text, and these are counted exactly, so neither false positives nor
equal hashes change a result. The number of segments follows the number of
lines, so a filter has the same size and error at every input size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import BLANKS, python_batches, table, written
from loomgraph.llm.suffix_family import having
from loomgraph.llm.textcodes import _CODES, _powers, mix, slices, texts

#: Documents that a line must be in, and code points that its key must have, to be repeated.
DOCUMENTS, CHARACTERS = 10, 1
#: Lines that a segment is made for, flags of each of its filters (16 for a line), and flags that a hash sets.
SEGMENT_LINES, FLAGS, SET = 1 << 20, 1 << 24, 4
#: Different hashes that a task holds before it hands them out.
HELD = 1 << 20
#: Keys, and bytes of them, up to which they are broadcast; more are joined.
FEW, FEW_BYTES = 200_000, 8 << 20
HASHES = "segment long, codes binary, counts binary"
SUSPECTS = "code long, key string, id long, content long"


def split(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All lines of some texts (null: one empty line), the row of each, and the number of lines of each row."""
    lines = pc.split_pattern(text.cast(pa.large_string()).fill_null(""), pattern="\n")
    per = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    return lines.flatten(), np.repeat(np.arange(len(per)), per), per


def keys(lines: pa.Array) -> pa.Array:
    """The keys of some lines."""
    return pc.ascii_lower(pc.ascii_trim(lines, characters=BLANKS))


def hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    data, at = texts(values)
    out = np.zeros(len(values), np.uint64)
    for lo, hi in slices(at):
        raw, ends = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        up, down = _powers(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_CODES[raw] * up[: len(raw)], out=sums[1:])
        out[lo:hi] = mix((sums[ends[1:]] - sums[ends[:-1]]) * down[ends[:-1]])
    return out


def _once_per_row(code: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Places of the first line of each hash in its row."""
    order = np.lexsort((code, row))
    new = np.ones(len(order), bool)
    new[1:] = (code[order][1:] != code[order][:-1]) | (row[order][1:] != row[order][:-1])
    return np.sort(order[new])


def _dealt(batches: Iterator[pa.RecordBatch], segments: int, characters: int) -> Iterator[pa.RecordBatch]:
    """The hashes of the task's lines with the number of its documents that have them, by segment."""
    shift = np.uint64(64 - (segments - 1).bit_length())
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        code, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        return code, np.bincount(at, weights=np.concatenate([n for _, n in held]), minlength=len(code)).astype(np.uint32)

    def out() -> pa.RecordBatch:
        code, count = merged()
        part = (code >> shift).astype(np.int64) if segments > 1 else np.zeros(len(code), np.int64)
        first = np.flatnonzero(np.diff(part, prepend=-1))
        ends = [*first[1:], len(part)]
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(part[first]), cut(code), cut(count)], names=["segment", "codes", "counts"])

    for batch in batches:
        lines, row, _ = split(batch.column("text"))
        key = keys(lines)
        code = hashes(key)
        long = pc.greater_equal(pc.utf8_length(key), characters).to_numpy(zero_copy_only=False)
        code, row = code[long], row[long]
        held.append(np.unique(code[_once_per_row(code, row)], return_counts=True))
        if sum(len(c) for c, _ in held) >= HELD:
            held = [merged()]
            if len(held[0][0]) >= HELD // 2:
                yield out()
                held = []
    if held:
        yield out()


def _flags(code: np.ndarray) -> np.ndarray:
    """The flags of each hash, a row for each."""
    step = mix(code) | np.uint64(1)
    return np.stack([(code + step * np.uint64(i)) & np.uint64(FLAGS - 1) for i in range(SET)]).astype(np.int64)


def _repeated(segment: pa.Table) -> pa.Table:
    """The segment's hashes that its twice-seen filter holds, with their counts."""
    once, twice = np.zeros(FLAGS, bool), np.zeros(FLAGS, bool)
    code = [np.frombuffer(b, np.uint64) for b in segment.column("codes").to_pylist()]
    count = [np.frombuffer(b, np.uint32) for b in segment.column("counts").to_pylist()]
    for c, n in zip(code, count, strict=True):  # within one handed-out run, hashes differ
        at = _flags(c)
        again = once[at].all(axis=0) | (n > 1)
        twice[at[:, again]] = True
        once[at] = True
    code, count = np.concatenate(code), np.concatenate(count)
    found = np.zeros(len(code), bool)
    for lo in range(0, len(code), HELD):
        found[lo : lo + HELD] = twice[_flags(code[lo : lo + HELD])].all(axis=0)
    return pa.table({"code": code[found].view(np.int64), "n": count[found].astype(np.int64)})


def suspects(docs: DataFrame, documents: int, characters: int) -> DataFrame:
    """Hashes (code, n) that may belong to lines of so many documents: all that do, and few others."""
    n_lines = docs.agg(F.sum(F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0)) + 1)).first()[0] or 0
    segments = 1 << max(0, -(-n_lines // SEGMENT_LINES) - 1).bit_length()
    dealt = docs.select("text").mapInArrow(partial(_dealt, segments=segments, characters=characters), HASHES)
    twice = dealt.groupBy("segment").applyInArrow(_repeated, "code long, n long")
    return twice.groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= documents)


def _lines_of(batches: Iterator[pa.RecordBatch], wanted, characters: int) -> Iterator[pa.RecordBatch]:
    """The lines of each document, each key once, of the wanted hashes (None: all)."""
    for batch in batches:
        lines, row, _ = split(batch.column("text"))
        key = keys(lines)
        code = hashes(key)
        at = np.flatnonzero(pc.greater_equal(pc.utf8_length(key), characters).to_numpy(zero_copy_only=False) & (True if wanted is None else np.isin(code, wanted.value)))
        # Keys are told apart by their text as well: two of one hash in one document both count.
        name = pc.dictionary_encode(key.take(pa.array(at))).indices.to_numpy(zero_copy_only=False).astype(np.uint64)
        at = at[_once_per_row(name, row[at])]
        of = pa.array(row[at])
        yield pa.RecordBatch.from_arrays([pa.array(code[at].view(np.int64)), key.take(pa.array(at)).cast(pa.string()), batch.column("id").take(of), batch.column("content").take(of)], names=["code", "key", "id", "content"])


def _without(batches: Iterator[pa.RecordBatch], dropped, schema: pa.Schema, listed: bool) -> Iterator[pa.RecordBatch]:
    """Adds the kept text and the numbers of lines; the dropped keys come with the rows, or are the same for all."""
    for batch in batches:
        lines, row, per = split(batch.column("text"))
        key = keys(lines)
        first = np.cumsum(per) - per
        gone = np.zeros(len(row), bool)
        spared: list[int] = []
        if listed:
            lists = batch.column("drops_").to_pylist()
            for r in (i for i, d in enumerate(lists) if d):
                known = {d["key"]: d["first"] for d in lists[r]}
                for j in range(first[r], first[r] + per[r]):
                    k = key[j].as_py()
                    if k in known:
                        gone[j] = True
                        if known[k]:
                            spared.append(j)
                            known[k] = False
        elif len(dropped.value["key"]):
            place = pc.index_in(key, value_set=dropped.value["key"])
            gone = pc.is_valid(place).to_numpy(zero_copy_only=False).copy()
            if dropped.value["first"] is not None:
                ids, contents = batch.column("id").to_pylist(), batch.column("content").to_pylist()
                left: dict[tuple, set] = {}
                for j in np.flatnonzero(gone):
                    k, r = place[int(j)].as_py(), int(row[j])
                    if dropped.value["first"][k] == (ids[r], contents[r]) and k not in left.setdefault((r,), set()):
                        left[(r,)].add(k)
                        spared.append(int(j))
        gone[spared] = False
        lost = np.bincount(row[gone], minlength=len(per))
        text = batch.column("text").fill_null("").to_pylist()
        for r in np.flatnonzero(lost):
            mine = slice(first[r], first[r] + per[r])
            text[r] = "\n".join(lines[mine].filter(pa.array(~gone[mine])).to_pylist())
        columns = {"kept_text": pa.array(text, pa.string()), "n_lines": pa.array(per), "n_dropped": pa.array(lost.astype(np.int64))}
        yield pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else batch.column(f.name) for f in schema], names=schema.names)


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", documents: int = DOCUMENTS, characters: int = CHARACTERS, keep: str = "none", few: int = FEW) -> DataFrame:
    """The documents (their key as `id`) without repeated lines: id, kept_text, n_lines, n_dropped.

    A line is repeated if its key has `characters` code points or more and is
    in `documents` rows or more, however often in each. `keep="none"` drops all
    its lines; "first" keeps the first line of the first row, by id (nulls
    last), then by a hash of the text; rows of equal id and text count as
    different documents, but keep or lose the same lines. A null or empty text
    is one empty line. Lines are split at line feeds only. Other input columns
    are not read, so their names can't clash. With over `few` repeated keys, or
    8 MB of them, keys are joined to documents instead of broadcast.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep must be none or first")
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).withColumn("content", F.xxhash64("text"))
    with python_batches(spark, 1024):
        asked = written(suspects(rows, documents, characters), "suspects")
        codes = asked.select("code").limit(few + 1).toPandas()["code"].to_numpy(np.int64).view(np.uint64)
        wanted = spark.sparkContext.broadcast(codes) if len(codes) <= few else None
        lines = rows.mapInArrow(partial(_lines_of, wanted=wanted, characters=characters), SUSPECTS)
        lines = lines if wanted is not None else having(lines, asked, "code")
        order = F.struct(F.col("id").isNull().alias("last"), "id", "content")
        counted = lines.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).where(F.col("n") >= documents)
        repeated = written(counted.select("key", "n", F.col("first.id").alias("id"), F.col("first.content").alias("content")), "repeated")
    total = repeated.select(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0)).alias("b")).first()
    out = "id long, kept_text string, n_lines long, n_dropped long"
    schema = pa.schema([("id", pa.int64()), ("kept_text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])
    if total["n"] <= few and total["b"] <= FEW_BYTES:
        found = repeated.select("key", "id", "content").collect()
        first = [(r["id"], r["content"]) for r in found] if keep == "first" else None
        dropped = spark.sparkContext.broadcast({"key": pa.array([r["key"] for r in found], pa.large_string()), "first": first})
        return rows.mapInArrow(partial(_without, dropped=dropped, schema=schema, listed=False), out)
    with python_batches(spark, 1024):
        lists = having(lines, repeated.select("key", "n"), "key")
        first = repeated.select("key", F.coalesce("id", F.lit(0)).alias("i_"), F.col("id").isNull().alias("no_"), "content", F.lit(keep == "first").alias("first"))
        lists = lists.withColumns({"i_": F.coalesce("id", F.lit(0)), "no_": F.col("id").isNull()}).join(first, ["key", "i_", "no_", "content"], "left")
        lists = lists.groupBy("i_", "no_", "content").agg(F.collect_set(F.struct("key", F.coalesce("first", F.lit(False)).alias("first"))).alias("drops_"))
        lists = written(lists, "dropped")
    keyed = rows.withColumns({"i_": F.coalesce("id", F.lit(0)), "no_": F.col("id").isNull()}).join(lists, ["i_", "no_", "content"], "left")
    return keyed.select("id", "text", "drops_").mapInArrow(partial(_without, dropped=None, schema=schema, listed=True), out)


def op13_line_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that 10 documents or more have.

    Null and repeated ids are documents like others; an empty table gives an
    empty result.
    """
    kept = deduplicated(table(spark, sf_dir, "documents"))
    with python_batches(spark, 1024):
        return written(kept.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")), "lines")


ORACLE = r"""
WITH l AS (
  SELECT row_id, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place
  FROM (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(r.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE r.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN r ON k.key = r.key GROUP BY row_id, doc_id
"""
