"""MinHash near-duplicates by a multi-index Hamming join.

A text's set of word shingles is sketched by 40 MinHash values of 16 bits. The
signature is split into 10 chunks of 4 values. Two signatures that differ in at
most 19 of the 40 values differ in at most one value of some chunk, by the
pigeonhole principle; so keys that leave out one value of a chunk in turn (40
keys a text) bring every such pair together, and no other key is needed. Pairs
are confirmed on the full shingle sets.

At a similarity of 0.75, a pair misses all keys with a probability below
2 in a million, and the more alike, the less. A pair that shares a key counts
whatever the distance of its signatures.

Groups of copies don't make pairs: equal sets are one class from the start. In
a bucket of equal keys, each class is first compared with one centre only, the
class that meets the most others; then classes of one bucket are compared with one another if they are not
yet in one component, which leaves little to do in groups of near copies. Of
these, only pairs whose sizes and bitmaps allow a link are looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import python_batches, send_package, table, written
from loomgraph.llm.components import components
from loomgraph.llm.textcodes import Words, mix, slices, texts, windows

SHINGLE_WORDS = 5
#: A link needs 100 * intersection >= SIMILAR * union.
SIMILAR = 75
CHUNKS, CHUNK = 10, 4
VALUES = CHUNKS * CHUNK
#: Signature distance under which the keys bring every pair together: one error a chunk, and one less than two in all.
DISTANCE = 2 * CHUNKS - 1
#: Ids up to which a table of them is broadcast; beyond it the join is left to Spark.
BROADCAST_IDS = 500_000
#: Classes of a bucket that are compared at once; larger buckets are dealt to blocks, and each two blocks that aren't of the largest component meet.
BLOCK = 2000
#: Pairs of one class that one task confirms; of more, the class's text is copied for each so many.
SPLIT = 1000
#: Bits of a set's bitmap, on which each shingle sets one; they bound what two sets can share.
BITMAP = 1024
SKETCH = "struct<n:bigint,class:bigint,signature:array<smallint>,bitmap:array<bigint>>"
SKETCH_TYPE = pa.struct([("n", pa.int64()), ("class", pa.int64()), ("signature", pa.list_(pa.int16())), ("bitmap", pa.list_(pa.int64()))])
_FACTORS = mix(np.arange(1000, 1000 + VALUES, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle codes of each text, sorted, one text after the other, and how many each has."""
    code, of = windows(Words(data, at, lower=True), SHINGLE_WORDS)
    if len(of) and (np.diff(of) < 0).any():
        order = np.argsort(of, kind="stable")
        code, of = code[order], of[order]
    ends = np.searchsorted(of, np.arange(len(at) - 1), "right")
    start = 0
    for end in ends:
        code[start:end].sort()
        start = end
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (of[1:] != of[:-1])
    return code[new], np.bincount(of[new], minlength=len(at) - 1)


def _sketches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for array in batches:
        data, at = texts(array)
        n_all, class_all, signatures, bitmaps = [], [], [], []
        for lo, hi in slices(at):
            code, n = shingle_sets(data, at[lo : hi + 1])
            some = np.flatnonzero(n)
            first = (np.cumsum(n) - n)[some]
            sums, values = np.zeros(len(n), np.uint64), np.zeros((len(n), VALUES), np.uint64)
            if len(some):
                sums[some] = mix(np.add.reduceat(mix(code ^ np.uint64(0xC1A55)), first) + n[some].astype(np.uint64))
                for j, f in enumerate(_FACTORS):
                    values[some, j] = np.minimum.reduceat(code * f, first)
            bits = np.zeros((len(n), BITMAP), np.uint8)
            bits[np.repeat(np.arange(len(n)), n), (mix(code ^ np.uint64(0xB175)) % np.uint64(BITMAP)).astype(np.int64)] = 1
            bitmaps.append(np.packbits(bits, axis=1).view(np.int64))
            n_all.append(n)
            class_all.append(sums.view(np.int64))
            signatures.append((mix(values) >> np.uint64(48)).astype(np.uint16).view(np.int16))
        size = sum(map(len, n_all))
        lists = []
        for parts, width, kind in ((signatures, VALUES, np.int16), (bitmaps, BITMAP // 64, np.int64)):
            flat = np.concatenate(parts).ravel() if parts else np.zeros(0, kind)
            lists.append(pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * width, pa.int32()), pa.array(flat)))
        yield pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (n_all, class_all)] + lists, fields=list(SKETCH_TYPE))


def _linked(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for left, right in batches:
        sets = []
        for array in (left, right):
            data, at = texts(array)
            found: list[np.ndarray] = []
            for lo, hi in slices(at):
                code, n = shingle_sets(data, at[lo : hi + 1])
                found += np.split(code, np.cumsum(n)[:-1])
            sets.append(found)
        out = []
        for a, b in zip(*sets, strict=True):
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(both > 0 and 100 * both >= SIMILAR * (len(a) + len(b) - both))
        yield pa.array(out, pa.bool_())


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of a bucket's rows, ordered by bucket, of different components and blocks that may be similar enough."""
    numbers = ("key", "lo", "hi", "block", "place", "class", "component", "n")
    held: list[np.ndarray] | None = None

    def compared(g: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        block, place, name, component, n, signature, bitmap = g[3:]
        bitmap = bitmap.view(np.uint64)  # counts of signed numbers would be of their absolute values
        across, found = g[1][0] != g[2][0], []
        for at in range(0, len(name), 64):
            x = slice(at, at + 64)
            good = component[x, None] < component[None, :]
            if across:
                good &= block[x, None] != block[None, :]
            # A bit that one set has and the other lacks is a shingle that they don't share.
            shared = bitmap[x, None, :] & bitmap[None, :, :]
            both = np.bitwise_count(shared).sum(axis=2, dtype=np.int64)
            bits = np.bitwise_count(bitmap).sum(axis=1, dtype=np.int64)
            most = np.minimum(n[x, None] - (bits[x, None] - both), n[None, :] - (bits[None, :] - both))
            good &= 100 * most >= SIMILAR * (n[x, None] + n[None, :] - most)
            i, j = np.nonzero(good)
            same = signature[i + at] == signature[j]
            # Of all keys that a pair shares, only the first one reports it.
            chunks = same.reshape(-1, CHUNKS, CHUNK)
            first = (chunks.sum(axis=2) >= CHUNK - 1).argmax(axis=1)
            here = first * CHUNK + (~chunks[np.arange(len(i)), first]).argmax(axis=1)
            near = here == place[j]
            found.append((name[i[near] + at], name[j[near]]))
        return tuple(np.concatenate([f[c] for f in found]) for c in range(2))

    for batch in _and_end(batches):
        if batch is None:
            groups = [held] if held is not None else []
        else:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in numbers]
            rows += [batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, w) for c, w in (("signature", VALUES), ("bitmap", BITMAP // 64))]
            if held is not None:
                rows = [np.concatenate(p) for p in zip(held, rows, strict=True)]
            new = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])) + 1
            ends = [0, *new.tolist()]
            groups = [[r[s:e] for r in rows] for s, e in zip(ends, ends[1:], strict=False)]
            held = [r[ends[-1] :] for r in rows]
        parts = [compared(g) for g in groups if len(g[0]) > 1]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[c] for p in parts]), pa.int64()) for c in range(2)], names=["a", "b"])


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None


def sketched(docs: DataFrame, text: str = "text", out: str = "sketch") -> DataFrame:
    """Adds a struct: n (size of the shingle set), class (64-bit hash of the set), signature."""
    send_package(docs.sparkSession)
    return docs.withColumn(out, F.arrow_udf(SKETCH)(_sketches)(F.col(text)))


def bucket_keys(signature: Column) -> Column:
    """The 40 keys of a signature: each chunk without each of its values in turn."""
    keys = []
    for c in range(CHUNKS):
        for left_out in range(CHUNK):
            rest = [signature[c * CHUNK + i] for i in range(CHUNK) if i != left_out]
            keys.append(F.xxhash64(F.lit(c * CHUNK + left_out), *rest))
    return F.array(*keys)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def class_links(docs: DataFrame, key: str, text: str, sketches: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between classes of different sets, enough of them to give the components.

    `sketches` has the columns row_key, n, class, signature and bitmap of the docs.
    """
    classes = written(sketches.where("n > 0").groupBy("class").agg(F.min("row_key").alias("row_key"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("bitmap").alias("bitmap")), "classes")
    keys = classes.select("class", F.posexplode(bucket_keys(F.col("signature"))).alias("place", "key"))
    shared = keys.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high").select("key", "size")
    members = written(keys.join(shared, "key"), "members")
    met = members.select("class").distinct().join(classes.select("class", "row_key"), "class")
    wanted = _small(written(met, "met").withColumnRenamed("class", "class_"))
    row_key = F.coalesce(F.col(key).cast("long"), F.xxhash64(text))
    found = docs.select(row_key.alias("row_key"), F.col(text).alias("text")).join(wanted, "row_key")
    found = sketched(found).where("sketch.class = class_").select(F.col("class_").alias("class"), "text")
    known = written(found.dropDuplicates(["class"]), "texts")

    def with_text(pairs: DataFrame, side: str) -> DataFrame:
        """The pairs with the text of one side, the pairs of a frequent class dealt to several tasks."""
        often = pairs.groupBy(side).agg(F.ceil(F.count(F.lit(1)) / SPLIT).alias("parts")).where("parts > 1")
        often = _small(written(often, "often"))
        dealt = pairs.join(often, side, "left").withColumn("part", F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(1)))).drop("parts")
        copies = known.withColumnRenamed("class", side).join(often, side, "left")
        copies = copies.select(side, F.col("text").alias(f"text_{side}"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        return dealt.join(copies, [side, "part"]).drop("part")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = with_text(with_text(written(pairs, "pairs"), "a"), "b")
        return both.where(F.arrow_udf("boolean")(_linked)("text_a", "text_b")).select("a", "b")

    # The class that meets the most others, such as the text from which near copies stem, is the centre of its buckets.
    met_most = members.groupBy("class").agg(F.sum("size").alias("meets"))
    ranked = members.join(met_most, "class")
    centres = ranked.groupBy("key").agg(F.max(F.struct("meets", "class")).alias("centre"))
    stars = ranked.select("key", "class").join(centres, "key").where("class <> centre.class").groupBy("class").agg(F.max("centre").alias("centre"))
    stars = stars.select(F.col("centre.class").alias("a"), F.col("class").alias("b"))
    links = written(confirmed(stars), "stars")
    joined = components(links, "a", "b")
    placed = members.join(joined.withColumnRenamed("node", "class"), "class", "left").select("key", "place", "class", F.coalesce("component", "class").alias("component"))
    placed = written(placed, "placed")
    # Blocks of a bucket's largest component needn't meet one another; they get the numbers after those of the rest.
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    open_ = sizes.groupBy("key").agg(F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("all")).where("all > top.size")
    open_ = open_.select("key", F.col("top.component").alias("largest"), F.ceil((F.col("all") - F.col("top.size")) / BLOCK).alias("rest"), F.ceil(F.col("top.size") / BLOCK).alias("more"))
    left = placed.join(open_, "key").join(classes.select("class", "n", "signature", "bitmap"), "class")
    in_it, spot = F.col("component") == F.col("largest"), F.xxhash64("class")
    left = left.withColumns({"block": F.when(in_it, F.col("rest") + F.pmod(spot, "more")).otherwise(F.pmod(spot, "rest")), "last": F.when(in_it, F.col("rest")).otherwise(F.col("rest") + F.col("more")) - 1})
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "place", "class", "component", "n", "signature", "bitmap")
    pairs = left.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_near_pairs, "a long, b long").distinct()
    more = written(confirmed(pairs), "links")
    return links.unionByName(more)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns row_key, the key, n_shingles, class, component, component_id and kept, one row per input row.

    component is the component's own name, the same for all of its rows and for
    no others, whatever their keys; it is null for a text without words.
    component_id is the smallest key that a row reaches over links; kept tells
    whether the row's own key is that. A text without words has an empty set,
    is linked with nothing and kept. Null keys count as larger than others: a
    row with a null key is kept only if all rows that it reaches have null keys.
    Classes are told apart by 64 bits.
    """
    with python_batches(docs.sparkSession, 256):
        return _near_duplicates(docs, key, text)


def _near_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    row_key = F.coalesce(F.col(key).cast("long"), F.xxhash64(text))
    rows = sketched(docs.select(F.col(key).alias("key_"), row_key.alias("row_key"), F.col(text).alias("text")))
    rows = written(rows.select("key_", "row_key", F.col("sketch.n").alias("n"), F.col("sketch.class").alias("class"), F.col("sketch.signature").alias("signature"), F.col("sketch.bitmap").alias("bitmap")), "sketches")
    links = class_links(docs, key, text, rows)
    found = components(links, "a", "b").withColumnRenamed("node", "class")
    least = rows.where("n > 0").groupBy("class").agg(F.min("key_").alias("least"))
    placed = written(least.join(found, "class", "left").select("class", "least", F.coalesce("component", "class").alias("component")), "components")
    heads = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("classes_"))
    # Components of one class, the most by far, need no join.
    alone = placed.join(heads.where("classes_ > 1").select("component", "component_id"), "component", "left").select("class", "component", F.coalesce("component_id", "least").alias("component_id"))
    out = rows.select("key_", "row_key", "n", "class").join(alone, "class", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key_"))
    return out.select("row_key", F.col("key_").alias(key), F.col("n").alias("n_shingles"), "class", F.when(F.col("n") > 0, F.col("component")).alias("component"), component.alias("component_id")).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of which one stays of each component; all columns of the input.

    Of a component's rows with its smallest key, those of the smallest row_key
    and class stay, and of these the first that Spark meets; so keys may be null
    or repeated. Empty texts all stay.
    """
    row_key = F.coalesce(F.col(key).cast("long"), F.xxhash64(text))
    rows = written(near_duplicates(docs, key, text), "verdicts")
    winners = rows.where("kept and n_shingles > 0").groupBy("component").agg(F.min(F.struct("row_key", "class")).alias("winner"))
    winners = written(winners.select(F.col("winner.row_key").alias("row_key_"), F.col("winner.class").alias("class_")), "winners")
    per_key = rows.groupBy(F.col("row_key").alias("row_key_")).agg(F.count(F.lit(1)).alias("rows_"), F.max("n_shingles").alias("most_"))
    per_key = per_key.join(winners.groupBy("row_key_").agg(F.count(F.lit(1)).alias("wins_")), "row_key_", "left")
    # A key of one row is decided by itself; rows that share one are told apart by their classes.
    out_of_it = written(per_key.where("rows_ > 1 or (most_ > 0 and wins_ is null)").select("row_key_", "rows_"), "dropped")
    unclear = out_of_it.where("rows_ > 1").select("row_key_")
    plain = docs.join(_small(out_of_it.select("row_key_")), row_key == F.col("row_key_"), "left_anti")
    some = sketched(docs.join(_small(unclear), row_key == F.col("row_key_")), text, "sketch_").withColumn("class_", F.col("sketch_.class"))
    empty = some.where("sketch_.n = 0").select(*docs.columns)
    one = some.where("sketch_.n > 0").dropDuplicates(["row_key_", "class_"]).join(winners, ["row_key_", "class_"], "left_semi").select(*docs.columns)
    return plain.unionByName(empty).unionByName(one)


def op4_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under shingles of five words and a similarity of 0.75.

    An empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")
