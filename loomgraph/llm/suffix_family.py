"""Suffix-array dedup over a logarithmic index family.

A text is removed where a string of 400 bytes covers it that starts anywhere
else too. The suffix arrays are sparse: of every 400-byte window, the suffix
whose first 32 bytes have the least hash (leftmost of equal ones) is indexed.
Two equal windows choose the same suffix at the same distance, so suffixes with
equal beginnings are all that has to be compared. A suffix array holds its
suffixes in the order of their bytes, to a depth of those 32.

A family lies in a folder of the shared file system. A batch of new texts gets
a suffix array, which is merge-scanned against each existing level for
beginnings that both have; the windows around these are compared, by content
that is refined step by step. Then the batch's array becomes level 0, and two
levels of one size are merged into the next, so n batches are rewritten log2(n)
times. Only the texts that a batch meets are read again. A later session opens
the folder and goes on.

A full suffix array of all bytes would need several times the bytes in ranks
and sorts and isn't needed for one fixed length; the sparse one loses nothing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import python_batches, shared_dir, table, written
from loomgraph.llm.textcodes import _CODES, Words, _powers, mix, slices, texts, windows

#: Bytes of a repeated string.
LENGTH = 400
#: Bytes at the beginning of a suffix by which suffixes are ordered and meet.
BEGINNING = 32
#: Batches in which the texts of one call arrive.
BATCHES = 2
#: Neighbouring windows that are compared together before they are compared one by one.
BLOCK = 46
#: Windows of a long text that are indexed at once.
SEGMENT = 1_000_000
#: Rows up to which a table of keys is broadcast; beyond it the join is left to Spark, but for hot keys.
BROADCAST_IDS = 500_000
#: Rows of one key from which it is hot.
HOT = 2_000
#: Every run of PASSAGE words that two texts share holds a chosen passage of CHOSEN words that they share.
PASSAGE, CHOSEN = 51, 26
ANCHORS = "array<struct<head:binary,around:bigint,first:int,place:int,windows:int>>"
ANCHOR_TYPE = pa.struct([("head", pa.binary()), ("around", pa.int64()), ("first", pa.int32()), ("place", pa.int32()), ("windows", pa.int32())])
SUFFIXES = "head binary, around long, text_id long, first int, place int, windows int"
MARKS = "text_id long, start int, end int"
MANIFEST = "batch int, level int, folder string"
_LOW = np.uint64((1 << 28) - 1)


def _sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_CODES[raw] * up[: len(raw)], out=sums[1:])
    return sums, down


def anchors(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """The indexed suffixes of some texts: text, place in raw, around, first window in the text, number of windows.

    `around` is a hash of all bytes of the windows that chose the suffix and of
    their places relative to it.
    """
    n, reach = len(raw), LENGTH - BEGINNING + 1
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return (none,) * 5
    sums, down = _sums(raw)
    m = n - BEGINNING + 1
    gram = mix((sums[BEGINNING:] - sums[:m]) * down[:m])
    rank = (gram & ~_LOW) | np.arange(m, dtype=np.uint64)
    rows = -(-m // reach) + 1
    wide = np.full(rows * reach, np.uint64(0xFFFFFFFFFFFFFFFF))
    wide[:m] = rank
    wide = wide.reshape(rows, reach)
    ahead = np.minimum.accumulate(wide, axis=1).ravel()
    behind = np.minimum.accumulate(wide[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - LENGTH + 1)
    place = (np.minimum(behind[starts], ahead[starts + reach - 1]) & _LOW).astype(np.int64)
    text = np.searchsorted(bounds, starts, "right") - 1
    inside = starts + LENGTH <= bounds[text + 1]
    starts, place, text = starts[inside], place[inside], text[inside]
    if not len(starts):
        return (none,) * 5
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(starts)))
    first, place, text = starts[at], place[at], text[at]
    whole = (sums[first + count + LENGTH - 1] - sums[first]) * down[first]
    around = mix(mix(whole) + (place - first).astype(np.uint64) * np.uint64(1 << 20) + count.astype(np.uint64))
    return text, place, around.view(np.int64), first - bounds[text], count


def _bytes(flat: np.ndarray, size: int) -> pa.Array:
    """An Arrow array of binary values of one size."""
    n = len(flat) // size
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def _indexed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for array in batches:
        data, at = texts(array)
        parts, sizes = [], []
        for lo, hi in slices(at):
            raw, bounds = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            step = SEGMENT if hi == lo + 1 else len(raw) + 1
            found = []
            for s in range(0, max(1, len(raw) - LENGTH + 1), step):
                piece = raw[s : s + step + LENGTH - 1]
                text, place, around, first, count = anchors(piece, bounds if step > len(raw) else np.array([0, len(piece)]))
                heads = np.lib.stride_tricks.sliding_window_view(piece, BEGINNING)[place] if len(place) else np.zeros((0, BEGINNING), np.uint8)
                found.append((text, heads.ravel(), around, first + s, place + s - bounds[text], count))
            found = [np.concatenate(c) for c in zip(*found, strict=True)]
            parts.append(found[1:])
            sizes.append(np.bincount(found[0].astype(np.int64), minlength=hi - lo))
        ends = np.cumsum(np.concatenate([[0], *sizes])).astype(np.int32)
        flat = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.uint8 if k == 0 else np.int64) for k in range(5)]
        columns = [_bytes(flat[0], BEGINNING), *(pa.array(c) for c in flat[1:])]
        rows = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, ANCHOR_TYPE, strict=True)], fields=list(ANCHOR_TYPE))
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def _columns(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, dict[str, np.ndarray]]]:
    """The text id, the bytes and the wanted places of each row (text_id, text, wanted)."""
    data, at = texts(batch.column("text"))
    wanted = batch.column("wanted")
    ends, fields = wanted.offsets.to_numpy(), wanted.values.flatten()
    names = [f.name for f in wanted.type.value_type]
    values = {n: v.to_numpy(zero_copy_only=False) for n, v in zip(names, fields, strict=True)}
    ids = batch.column("text_id").to_numpy()
    for k in range(len(ids)):
        yield int(ids[k]), data[at[k] : at[k + 1]], {n: v[ends[k] : ends[k + 1]] for n, v in values.items()}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the windows of wanted suffixes into blocks by their distance from the suffix.

    `common` is a hash of the bytes that all windows of a block have, `whole`
    one of all bytes of those that chose the suffix: blocks that differ in
    `common` share no window, blocks that agree in `whole` share all.
    """
    for batch in batches:
        out: list[tuple] = []
        for text_id, raw, w in _columns(batch):
            sums, down = _sums(raw)
            place, first = w["place"].astype(np.int64), w["first"].astype(np.int64)
            far, near = place - first, place - first - w["windows"] + 1
            low, high = near // BLOCK, far // BLOCK
            per = high - low + 1
            at = np.repeat(np.arange(len(per)), per)
            b = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per) + low[at]
            place, start = place[at], place[at] - np.minimum(far[at], (b + 1) * BLOCK - 1)
            count = place - np.maximum(near[at], b * BLOCK) - start + 1
            lo, hi = place - b * BLOCK, place - (b + 1) * BLOCK + 1 + LENGTH
            turn = lambda x, by: mix(mix(x) + by.astype(np.uint64))
            common = turn((sums[hi] - sums[lo]) * down[lo], b)
            whole = turn((sums[start + count + LENGTH - 1] - sums[start]) * down[start], (place - start) * (1 << 20) + count)
            out.append((np.full(len(b), text_id), common.view(np.int64), whole.view(np.int64), start, count, w["alone"][at]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(cols, kinds, strict=True)], names=["text_id", "common", "whole", "first", "windows", "alone"])


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A 64-bit hash of each window of the wanted blocks."""
    for batch in batches:
        out: list[tuple] = []
        for text_id, raw, w in _columns(batch):
            sums, down = _sums(raw)
            per = w["windows"].astype(np.int64)
            at = np.repeat(np.arange(len(per)), per)
            start = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per) + w["first"].astype(np.int64)[at]
            code = mix((sums[start + LENGTH] - sums[start]) * down[start])
            out.append((np.full(len(start), text_id), code.view(np.int64), start, w["alone"][at]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.bool_()), strict=True)], names=["text_id", "code", "start", "alone"])


def _few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS


def having(rows: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """The rows whose key is in `keys` (the key and n, the rows that have it; one row a key).

    A table of few keys is broadcast. Of more, the hot ones are broadcast, as
    long as they are few, so that no task gets all rows of one key.
    """
    on = [on] if isinstance(on, str) else on
    if _few(keys):
        return rows.join(F.broadcast(keys.select(*on)), on, "left_semi")
    hot, cold = keys.where(F.col("n") > HOT).select(*on), keys.where(F.col("n") <= HOT).select(*on)
    found = rows.join(cold, on, "left_semi")
    return found.unionByName(rows.join(F.broadcast(hot) if _few(hot) else hot, on, "left_semi"))


def _some_texts(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts (text_id, text) of the wanted ids, each once, with their wanted places."""
    lists = written(wanted.groupBy("text_id").agg(F.collect_list(F.struct(*(c for c in wanted.columns if c != "text_id"))).alias("wanted")), "wanted")
    ids = lists.select("text_id", F.lit(1).alias("n"))
    return having(known, ids, "text_id").dropDuplicates(["text_id"]).join(lists, "text_id")


class Family:
    """Suffix arrays of the texts of all batches so far, in a folder; level k holds 2^k batches.

    A batch that fails half-way leaves files that nothing refers to: the
    manifest names the levels, texts and runs of each batch, and is written last.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        try:
            rows = spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest").collect()  # a row per level, batch and run
        except AnalysisException:
            rows = []
        self.batches = max((r["batch"] for r in rows), default=0)
        self.levels = {r["level"]: r["folder"] for r in rows if r["batch"] == self.batches and r["level"] >= 0}
        self.texts_in = [r["folder"] for r in rows if r["level"] == -1]
        self.runs_in = [r["folder"] for r in rows if r["level"] == -2]

    def _save(self, df: DataFrame, kind: str) -> str:
        folder = f"{self.root}/{kind}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        return folder

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def level(self, k: int) -> DataFrame:
        """The suffix array of one level, in files whose rows are in order."""
        return self._read([self.levels[k]], SUFFIXES)

    def texts(self) -> DataFrame:
        """All texts of the family (text_id, text), as often as they came within a batch."""
        return self._read(self.texts_in, "text_id long, text string")

    def runs(self) -> DataFrame:
        """All runs (text_id, start, end) so far that occur elsewhere too."""
        return self._read(self.runs_in, MARKS)

    def _ordered(self, suffixes: DataFrame) -> str:
        by = ("head", "around", "text_id", "first")  # the later columns part the rows of a hot beginning
        return self._save(suffixes.repartitionByRange(*by).sortWithinPartitions(*by), "level")

    def add(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Takes new texts in; returns the runs (text_id, start, end) of new and old texts that they repeat.

        text_id is a 64-bit hash of the text. Equal texts are one, also across
        batches; that they are repeated as a whole is not among the runs. Null
        texts and those of under 400 bytes are left out.
        """
        with python_batches(self.spark, 256):
            return self._add(docs, text)

    def _add(self, docs: DataFrame, text: str) -> DataFrame:
        rows = docs.where(F.octet_length(text) >= LENGTH).select(F.xxhash64(text).alias("text_id"), F.col(text).alias("text"))
        if self.texts_in:
            rows = rows.join(self.texts().select("text_id").distinct(), "text_id", "left_anti")
        new_texts = self._save(rows, "texts")
        once = self._read([new_texts], "text_id long, text string").select("text_id", F.arrow_udf(ANCHORS)(_indexed)("text").alias("a")).dropDuplicates(["text_id"])
        mine = self._ordered(once.select("text_id", F.inline("a")).select("head", "around", "text_id", "first", "place", "windows"))
        batch = self._read([mine], SUFFIXES)
        folders = [*self.levels.values(), mine]
        beginnings = batch.groupBy("head").agg(F.count(F.lit(1)).alias("n"))
        for k in self.levels:
            beginnings = beginnings.join(self.level(k).groupBy("head").agg(F.count(F.lit(1)).alias("m")), "head", "left").select("head", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))
        shared = written(beginnings.where("n > 1"), "shared")
        runs = self._repeated(having(self._read(folders, SUFFIXES), shared, "head"), [*self.texts_in, new_texts])
        new_runs = self._save(runs, "runs")
        size = 0
        while size in self.levels:
            mine = self._ordered(self._read([mine, self.levels.pop(size)], SUFFIXES))
            size += 1
        self.levels[size] = mine
        self.batches += 1
        self.texts_in.append(new_texts)
        self.runs_in.append(new_runs)
        entries = [(self.batches, k, f) for k, f in self.levels.items()] + [(self.batches, -1, new_texts), (self.batches, -2, new_runs)]
        self.spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return self._read([new_runs], MARKS)

    def _repeated(self, met: DataFrame, texts_in: list[str]) -> DataFrame:
        known = self._read(texts_in, "text_id long, text string")
        met = written(met, "met")
        # Suffixes with the same surroundings are repeated with all their windows, and one of them stands for all.
        alike = written(met.groupBy("head", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("text_id", "first", "place", "windows")).alias("one")), "alike")
        run = lambda size: (F.col("first").alias("start"), (F.col("first") + size + (LENGTH - 1)).alias("end"))
        out = having(met, alike.where("n > 1").select("head", "around", "n"), ["head", "around"]).select("text_id", *run(F.col("windows")))
        differing = alike.groupBy("head").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        compared = having(alike.select("head", "n", "one.*").withColumn("alone", F.col("n") == 1).drop("n"), differing, "head").select("text_id", "first", "place", "windows", "alone")
        blocks = written(_some_texts(known, compared).mapInArrow(_blocks, "text_id long, common long, whole long, first int, windows int, alone boolean"), "blocks")
        alike = written(blocks.groupBy("common", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("text_id", "first", "windows", "alone")).alias("one")), "alike")
        several = having(blocks.where("alone"), alike.where("n > 1").select("common", "whole", "n"), ["common", "whole"])
        out = out.unionByName(several.select("text_id", *run(F.col("windows"))))
        differing = alike.groupBy("common").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        compared = having(alike.select("common", "n", "one.*"), differing, "common").select("text_id", "first", "windows", (F.col("alone") & (F.col("n") == 1)).alias("alone"))
        codes = written(_some_texts(known, compared).mapInArrow(_codes, "text_id long, code long, start int, alone boolean"), "codes")
        twice = written(codes.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "twice")
        single = having(codes.where("alone"), twice, "code").select("text_id", "start", (F.col("start") + LENGTH).alias("end"))
        return out.unionByName(single)


def _kept(rows: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    kind = pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    for text_array, run_array in rows:
        out = []
        for text, runs in zip(text_array.to_pylist(), run_array.to_pylist(), strict=True):
            raw, at, removed, spans, kept = (text or "").encode(), 0, 0, 0, hashlib.sha256()
            ends: list[list[int]] = []
            for r in sorted(runs, key=lambda r: r["start"]):
                if ends and r["start"] <= ends[-1][1]:
                    ends[-1][1] = max(ends[-1][1], r["end"])
                else:
                    ends.append([r["start"], r["end"]])
            for start, end in ends:
                kept.update(raw[at:start])
                at, removed, spans = end, removed + end - start, spans + 1
            kept.update(raw[at:])
            out.append({"n_removed": removed, "n_spans": spans, "kept_sha256": kept.hexdigest()})
        yield pa.array(out, kind)


def _passages(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The chosen passages of each text: of every 26 neighbouring ones of 26 words, the one with the least hash."""
    reach = PASSAGE - CHOSEN + 1
    for array in batches:
        data, at = texts(array)
        codes, sizes = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for lo, hi in slices(at):
            code, text = windows(Words(data, at[lo : hi + 1], False), CHOSEN)
            n, per = len(code) - reach + 1, np.zeros(hi - lo, np.int64)
            if n > 0:
                least = code[:n].copy()
                for j in range(1, reach):
                    np.minimum(least, code[j : j + n], out=least)
                inside = text[:n] == text[reach - 1 :]
                least, text = least[inside], text[:n][inside]
                new = np.ones(len(least), bool)
                new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
                codes.append(least[new].view(np.int64))
                per = np.bincount(text[new], minlength=hi - lo)
            sizes.append(per)
        yield pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), pa.array(np.concatenate(codes)))


def shared_passages(docs: DataFrame, text: str = "text") -> DataFrame:
    """For each text (text_id) of 51 words or more, the number of its chosen passages that a different text has too.

    Of every run of 51 words, one passage of 26 words is chosen by its content,
    so two texts that share the run share the passage. Words are compared as
    they are, white space between them is not.
    """
    rows = docs.where(F.octet_length(text) > 2 * PASSAGE - 2).select(F.xxhash64(text).alias("text_id"), F.explode(F.arrow_udf("array<bigint>")(_passages)(text)).alias("key"))
    with python_batches(docs.sparkSession, 256):
        rows = written(rows, "passages")
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("text_id").alias("a"), F.max("text_id").alias("b")).where("a <> b").select("key", "n")
    shared = having(rows, written(keys, "keys"), "key").distinct().groupBy("text_id").agg(F.count(F.lit(1)).alias("n_passages"))
    return rows.select("text_id").distinct().join(shared, "text_id", "left").select("text_id", F.coalesce("n_passages", F.lit(0)).alias("n_passages"))


def deduplicated(docs: DataFrame, text: str = "text", batches: int = BATCHES, family: Family | None = None) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans, kept_sha256 and shared_passages.

    The texts are taken into the family (a new one, unless one is given) in so
    many batches; what they share with texts that a given family already holds
    counts as repeated. A null text counts as empty. A text that occurs twice as
    a whole and has 400 bytes is removed as a whole; shorter texts keep all
    bytes. shared_passages is above 0 for every document that shares a run of
    over 50 words with another one of `docs`, and 0 where it shares no 26 words.
    Input columns called like the outputs are replaced.
    """
    spark = docs.sparkSession
    if family is None:
        family = Family(spark, f"{shared_dir(spark).rstrip('/')}/loomgraph/family-{uuid.uuid4().hex}")
    content = F.coalesce(F.col(text), F.lit(""))
    for b in range(batches):
        family.add(docs.where(F.pmod(F.xxhash64(text), F.lit(batches)) == b), text)
    lists = family.runs().groupBy("text_id").agg(F.collect_set(F.struct("start", "end")).alias("runs"))
    lists = written(lists, "lists")
    known = having(family.texts(), lists.select("text_id", F.lit(1).alias("n")), "text_id").dropDuplicates(["text_id"])
    with python_batches(spark, 256):
        kept = written(known.join(lists, "text_id").select("text_id", F.arrow_udf("struct<n_removed:bigint,n_spans:bigint,kept_sha256:string>")(_kept)("text", "runs").alias("r_")), "kept")
    passages = written(shared_passages(docs, text), "shared_passages")
    rows = docs.withColumns({"text_id": F.xxhash64(content), "n_bytes": F.octet_length(content).cast("long"), "sha_": F.sha2(content.cast("binary"), 256)}).drop("n_removed", "n_spans", "kept_sha256", "shared_passages", text)
    copied = rows.where(F.col("n_bytes") > 2 * PASSAGE - 2).groupBy("text_id").agg(F.count(F.lit(1)).alias("copies_")).where("copies_ > 1").select("text_id", F.lit(True).alias("copied_"))
    out = rows.join(copied, "text_id", "left").join(kept, "text_id", "left").join(passages, "text_id", "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    gone = F.col("copied_") & (F.col("n_bytes") >= LENGTH)
    return out.withColumns({
        "n_removed": F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("r_.n_removed", F.lit(0))).cast("long"),
        "n_spans": F.when(gone, F.lit(1)).otherwise(F.coalesce("r_.n_spans", F.lit(0))).cast("long"),
        "kept_sha256": F.when(gone, nothing).otherwise(F.coalesce("r_.kept_sha256", "sha_")),
        "shared_passages": F.when(F.col("copied_") & F.col("n_passages").isNotNull(), F.greatest("n_passages", F.lit(1))).otherwise(F.coalesce("n_passages", F.lit(0))).cast("long"),
    }).drop("text_id", "sha_", "copied_", "copies_", "r_", "n_passages")


def op10_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated strings of 400 bytes, and the passages of over 50 words that it shares.

    An empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "shared_passages")
