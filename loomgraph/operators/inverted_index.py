"""A stored inverted index over memories: postings by term, searched from the best score band down.

A posting holds a term, a memory's id, the term's count, the memory's number of
words and what searches filter by. The score of a term in a memory is its count
over 1 + ln(words), and that of a memory the sum over the wanted terms, as in
the scan. Words are counted, and postings ordered by term and score band, where
their memories are; a task writes a file per bucket of the term, so a search
reads the row groups of its terms only. Bands are
powers of 2^(1/4); a table of terms has the number of postings in each band.

A search for all of some terms goes down the bands of the rarest one, more of
them each time, joins these postings with those of the other terms, and ends
when no memory of a lower band could reach the k-th score.

Batches are added as segments; removed ids are tombstones that hold for earlier
segments. A manifest, written last, names what counts, so that a batch that
fails half-way changes nothing; compact() rewrites all as one segment.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import tokens
from loomgraph.session import send_package

#: Folders of postings, bands for each doubling of the score, and postings that a search reads first.
BUCKETS, BANDS, FIRST_READ = 64, 4, 10_000
#: Memories whose words a task counts at once.
ROWS_COUNTED = 256
POSTINGS = "term string, band int, id long, n int, size int, expires_at timestamp_ntz, organization string, team string, project string, segment int, bucket int"
TERMS = "term string, band int, n_postings long, segment int"
MANIFEST = "version int, segment int, kind string, folder string"
SCOPES = ("organization", "team", "project")


def impact(n: Column, size: Column) -> Column:
    """The score of one term in a memory."""
    return n / (1 + F.log(size.cast("double")))


def _counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The different words of each array with their counts and the array's size; a part of a batch at a time."""
    kind = pa.struct([("term", pa.string()), ("n", pa.int32()), ("size", pa.int32())])
    for batch in batches:
        for lo in range(0, len(batch), ROWS_COUNTED):
            words = batch.slice(lo, ROWS_COUNTED).fill_null([])
            flat = pc.dictionary_encode(words.flatten())
            many = max(1, len(flat.dictionary))
            sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int32)
            of = np.repeat(np.arange(len(words)), sizes)
            pairs, n = np.unique(of * many + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
            ends = np.searchsorted(pairs, np.arange(len(words) + 1) * many).astype(np.int32)
            terms = flat.dictionary.take(pa.array(pairs % many))
            yield pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([terms, pa.array(n.astype(np.int32)), pa.array(sizes[pairs // many])], fields=list(kind)))


class InvertedIndex:
    """The index in a folder; opening it again finds what was added."""

    def __init__(self, spark: SparkSession, folder: str, words: Callable[[Column], Column] = tokens):
        send_package(spark)
        self.spark, self.folder, self.words = spark, folder.rstrip("/"), words
        try:
            rows = spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest").collect()  # a row per segment
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = []
        self.version = max((r["version"] for r in rows), default=0)
        self.entries = [(r["segment"], r["kind"], r["folder"]) for r in rows if r["version"] == self.version]

    def _read(self, kind: str, schema: str) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f) for _, k, f in self.entries if k == kind]
        out = parts[0] if parts else self.spark.createDataFrame([], schema)
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def postings(self) -> DataFrame:
        return self._read("postings", POSTINGS)

    def removed(self) -> DataFrame:
        """Ids that don't count in segments up to the given one."""
        return self._read("removed", "id long, upto int")

    def _commit(self, entries: list[tuple[int, str, str]]) -> None:
        self.version, self.entries = self.version + 1, entries
        self.spark.createDataFrame([(self.version, *e) for e in entries], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def _segment(self) -> int:
        return max((s for s, _, _ in self.entries), default=0) + 1

    def _save(self, postings: DataFrame, segment: int) -> list[tuple[int, str, str]]:
        at = f"{self.folder}/segment-{segment}-{uuid.uuid4().hex}"
        rows = postings.withColumns({"segment": F.lit(segment), "bucket": F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")})
        # Each task orders the postings of its own memories; so none are shuffled, and a search reads its terms' row groups of every task's file.
        rows.sortWithinPartitions("bucket", "term", "band", "id").write.partitionBy("bucket").parquet(f"{at}/postings")
        kept = self.spark.read.schema(POSTINGS).parquet(f"{at}/postings")
        terms = kept.groupBy("term", "band").agg(F.count(F.lit(1)).alias("n_postings"), F.max("segment").alias("segment"))
        terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{at}/terms")
        return [(segment, "postings", f"{at}/postings"), (segment, "terms", f"{at}/terms")]

    def add(self, memories: DataFrame, content: str = "content") -> None:
        """Takes in memories (id, the content, expires_at, scopes), which replace those of equal ids.

        A null content, or one without words, has no postings.
        """
        segment = self._segment()
        repeated = memories.groupBy("id").agg(F.count(F.lit(1)).alias("rows_")).where("rows_ > 1").select("id")
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
        rows = memories.select("id", "expires_at", *SCOPES, content).repartition(tasks)  # few large files would be few tasks
        rows = rows.select("id", "expires_at", *SCOPES, self.words(F.col(content)).alias("words"))
        counted = F.arrow_udf("array<struct<term:string,n:int,size:int>>")(_counted)("words")
        counts = rows.select("id", "expires_at", *SCOPES, F.inline(counted))
        if not repeated.isEmpty():  # the rows of an id count as one
            twice = counts.join(repeated, "id", "left_semi").groupBy("id", "term").agg(F.sum("n").cast("int").alias("n"), *[F.max(c).alias(c) for c in ("size", "expires_at", *SCOPES)])
            counts = counts.join(repeated, "id", "left_anti").unionByName(twice)
        band = F.ceil(BANDS * F.log2(impact(F.col("n"), F.col("size")))).cast("int")
        made = self._save(counts.withColumn("band", band), segment)
        gone = self._tombstones(memories.select("id"), segment - 1) if self.entries else []
        self._commit([*self.entries, *made, *gone])

    def _tombstones(self, ids: DataFrame, upto: int) -> list[tuple[int, str, str]]:
        at = f"{self.folder}/removed-{uuid.uuid4().hex}"
        ids.select("id", F.lit(upto).alias("upto")).distinct().write.parquet(at)
        return [(upto, "removed", at)]

    def remove(self, ids: DataFrame) -> None:
        """Takes memories of these ids out."""
        self._commit([*self.entries, *self._tombstones(ids, self._segment() - 1)])

    def compact(self) -> None:
        """Rewrites all segments as one, without what was removed."""
        self._commit(self._save(self.living(self.postings()).drop("segment", "bucket"), self._segment()))

    def living(self, postings: DataFrame) -> DataFrame:
        """The postings whose memory wasn't removed or replaced since."""
        if not any(kind == "removed" for _, kind, _ in self.entries):
            return postings
        gone = self.removed().groupBy("id").agg(F.max("upto").alias("upto"))
        return postings.join(gone, "id", "left").where("upto is null or segment > upto").drop("upto")

    def of_terms(self, terms: Sequence[str], where: Column | None = None) -> DataFrame:
        """Living postings of some terms, from their folders only; `where` is pushed to the files as well."""
        spark = self.spark
        buckets = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(BUCKETS))).distinct().collect()]
        rows = self.postings().where(F.col("bucket").isin(buckets) & F.col("term").isin(*terms))
        return self.living(rows if where is None else rows.where(where))

    def topk(self, terms: Sequence[str], k: int, as_of: str, first_read: int = FIRST_READ, **scope: str | None) -> DataFrame:
        """The k memories that hold all terms: id, text_score, rank; the rows that the scan finds."""
        terms = list(dict.fromkeys(terms))
        order = Window.orderBy(F.desc("text_score"), "id")
        none = self.spark.createDataFrame([], "id long, text_score double, rank int")
        stats = self._read("terms", TERMS).where(F.col("term").isin(*terms)).groupBy("term", "band").agg(F.sum("n_postings").alias("n")).collect() if terms else []
        if {r["term"] for r in stats} != set(terms) or not terms:
            return none
        total = {t: sum(r["n"] for r in stats if r["term"] == t) for t in terms}
        top = {t: max(r["band"] for r in stats if r["term"] == t) for t in terms}
        rare = min(terms, key=lambda t: (total[t], t))
        bands = sorted(((r["band"], r["n"]) for r in stats if r["term"] == rare), reverse=True)
        most = sum(2 ** (top[t] / BANDS) for t in terms if t != rare)
        keep = F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of).cast("timestamp_ntz"))
        for name, value in scope.items():
            keep = keep if value is None else keep & (F.col(name) == value)
        at, read, found = 0, first_read, none
        while at < len(bands):
            upto, n = at, 0
            while upto < len(bands) and (n == 0 or n + bands[upto][1] <= read):
                n += bands[upto][1]
                upto += 1
            low, high = bands[upto - 1][0], bands[at][0]
            some = self.of_terms([rare], F.col("band").between(low, high) & keep).select("id", "n", "size")
            if len(terms) > 1:
                # A memory has one posting a term; the rare term's few meet the others where these are read.
                others = self.of_terms([t for t in terms if t != rare], keep).select("id", F.col("n").alias("m"))
                others = others.join(some.select("id"), "id", "left_semi").groupBy("id").agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("with"))
                some = some.join(others.where(F.col("with") == len(terms) - 1), "id").select("id", (F.col("n") + F.col("m")).alias("n"), "size")
            best = some.select("id", F.round(impact(F.col("n"), F.col("size")), 9).alias("text_score")).orderBy(F.desc("text_score"), "id").limit(k)
            kept = sorted(((r["text_score"], r["id"]) for r in [*found.select("id", "text_score").collect(), *best.collect()]), key=lambda x: (-x[0], x[1]))[:k]
            found = self.spark.createDataFrame([(i, s) for s, i in kept], "id long, text_score double")
            at, read = upto, read * 4
            if len(kept) == k and at < len(bands) and 2 ** (bands[at][0] / BANDS) + most + 1e-6 < kept[-1][0]:
                break
        return found.select("id", "text_score", F.row_number().over(order).alias("rank"))
