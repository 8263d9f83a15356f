"""Benchmark decontamination by the q-gram lemma.

A passage within k edits of an item of n characters shares at least
n - q + 1 - k * q q-grams with it, and their diagonals (place in the text less
place in the item) differ by at most k. Shared q-grams are counted in
overlapping diagonal bands; bands that reach the bound are verified by an
alignment in the band. Items too short for an edit are looked for unedited.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import send_package, table, written

Q = 8
#: Edits allowed per character of an item.
EDIT_SHARE = 0.06
#: An item counts as found where any of its pieces is found within the piece's own budget: one piece of so many characters at every half of that, or the whole item if it is shorter.
PIECE = 256
#: Items with fewer characters have no edit in their budget: they count where they occur unedited, between characters that are no letters or digits.
LEAST = math.ceil(1 / EDIT_SHARE)
#: Characters of items in one broadcast index; more items are searched for in several passes, one index at a time.
BLOCK_CHARS = 4_000_000
SLICE_CHARS = 1_000_000
TABLE_BITS = 22
_FACTORS = {j: np.uint64(pow(0x9E3779B97F4A7C15, j, 1 << 64)) for j in (1, 2, 4)}
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
HITS = "array<struct<item_id:bigint,distance:int,start:int,end:int>>"


def normalised(text: str | None) -> str:
    """Lower case, with single spaces."""
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(chars: np.ndarray) -> np.ndarray:
    """64-bit hash of the q-gram at each place: pairs, then fours, then eights of characters."""
    h = chars.astype(np.uint64)
    for j in (1, 2, 4):
        h = h[:-j] * _FACTORS[j] + h[j:] if len(h) > j else h[:0]
    return h * _SPREAD


@dataclass
class Index:
    """The pieces of some items and the postings of their q-grams."""

    item: np.ndarray  # of each piece
    chars: list[np.ndarray]
    edits: np.ndarray
    bound: np.ndarray
    gram: np.ndarray  # sorted, distinct
    first: np.ndarray
    piece: np.ndarray
    place: np.ndarray
    maybe: np.ndarray
    window: int  # places in which some window of every hit has at least `seed` shared q-grams
    seed: int
    short: ahocorasick.Automaton  # of items under LEAST: their characters, ids

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> Index:
        item, chars, brief = [], [], {}
        for i, t in items:
            c = codes(normalised(t))
            if 0 < len(c) < LEAST:
                brief.setdefault(normalised(t), []).append(i)
            starts = [0] if len(c) <= PIECE else [*range(0, len(c) - PIECE, PIECE // 2), len(c) - PIECE]
            for s in starts if len(c) >= LEAST else []:
                item.append(i)
                chars.append(c[s : s + PIECE])
        size = np.array([len(c) for c in chars], np.int64)
        edits = np.floor(size * EDIT_SHARE).astype(np.int64)
        found = [grams(c) for c in chars]
        per = np.array([len(g) for g in found], np.int64)
        all_grams = np.concatenate(found) if found else np.zeros(0, np.uint64)
        piece = np.repeat(np.arange(len(chars)), per)
        place = np.arange(len(all_grams)) - np.repeat(np.cumsum(per) - per, per)
        order = np.argsort(all_grams, kind="stable")
        gram, first = np.unique(all_grams[order], return_index=True)
        maybe = np.zeros(1 << TABLE_BITS, bool)
        maybe[(gram >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        bound = size - Q + 1 - edits * Q
        # A hit's q-grams lie in size + edits places; of as many windows as cover these, one has its share.
        window = int((size + edits).min()) if len(size) else 1
        seed = int((-(-bound // -(-(size + edits) // window))).min()) if len(size) else 1
        short = ahocorasick.Automaton()
        for t, ids in brief.items():
            short.add_word(t, (len(t), ids))
        short.make_automaton()
        return cls(np.array(item, np.int64), chars, edits, bound, gram, np.append(first, len(all_grams)), piece[order], place[order], maybe, window, max(1, seed), short)

    def unedited(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of each short item's first place in a normalised text."""
        seen: set[int] = set()
        for last, (size, ids) in self.short.iter(text) if len(self.short) else ():
            start, end = last + 1 - size, last + 1
            if not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum()):
                for i in ids:
                    if i not in seen:
                        seen.add(i)
                        yield i, start, end

    def search(self, chars: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Hits (text, item, distance, start, end) in a run of texts; `text` has each character's text, -1 between texts."""
        g = grams(chars)
        if not len(g) or not self.chars:
            return []
        shared = self.maybe[(g >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
        sums = np.zeros(len(g) + 1 + self.window, np.int32)
        np.cumsum(shared, out=sums[1 : len(g) + 1])
        sums[len(g) + 1 :] = sums[len(g)]
        seeds = np.flatnonzero(sums[self.window :] - sums[: len(g) + 1] >= self.seed)
        if not len(seeds):
            return []
        # Only places in reach of a window that is full enough can belong to a hit.
        reach = max(len(c) for c in self.chars) + int(self.edits.max())
        cut = np.flatnonzero(np.diff(seeds) > 2 * reach + self.window)
        low, high = seeds[np.append(0, cut + 1)] - reach, seeds[np.append(cut, len(seeds) - 1)] + self.window + reach
        at = np.concatenate([np.flatnonzero(shared[max(0, a) : b]) + max(0, a) for a, b in zip(low.tolist(), high.tolist(), strict=True)])
        at = at[text[at] == text[at + Q - 1]]
        k = np.searchsorted(self.gram, g[at])
        good = k < len(self.gram)
        good[good] = self.gram[k[good]] == g[at[good]]
        at, k = at[good], k[good]
        if not len(at):
            return []
        per = self.first[k + 1] - self.first[k]
        posting = np.repeat(self.first[k] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
        piece, spot = self.piece[posting], np.repeat(at, per)
        diagonal = spot - self.place[posting]
        width = self.edits[piece] + 1
        # Where a piece shares all its q-grams on one diagonal, it is there unedited.
        line, full = np.unique(piece * np.int64(1 << 32) + diagonal + (1 << 20), return_counts=True)
        sizes = np.array([len(c) for c in self.chars])
        exact: dict[int, list[int]] = {}
        for x in line[full >= sizes[line >> 32] - Q + 1].tolist():
            p, start = x >> 32, (x & ((1 << 32) - 1)) - (1 << 20)
            if start >= 0 and np.array_equal(chars[start : start + sizes[p]], self.chars[p]):
                exact.setdefault(p, []).append(start)
        # A band is of one text: its q-grams are counted, and its alignment is looked for, in that text alone.
        breaks = np.flatnonzero(text < 0)
        owner = np.searchsorted(breaks, spot)
        bands = np.concatenate([diagonal // width, diagonal // width - 1])
        key = np.concatenate([piece, piece]) * np.int64(1 << 32) + bands + (1 << 20)
        owner = np.concatenate([owner, owner])
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))
        counts = np.diff(np.append(new, len(key)))
        key, owner = key[new], owner[new]
        piece = key >> 32
        enough = counts >= np.maximum(1, self.bound[piece])
        begins, ends = np.append(0, breaks + 1), np.append(breaks, len(chars))
        out = {}
        for p, b, o in zip(piece[enough].tolist(), ((key[enough] & ((1 << 32) - 1)) - (1 << 20)).tolist(), owner[enough].tolist(), strict=True):
            k_, c = int(self.edits[p]), self.chars[p]
            lo, begin, end = b * (k_ + 1) - k_, int(begins[o]), int(ends[o])
            same = next((x for x in exact.get(p, ()) if lo <= x <= lo + 4 * k_ + 2 and begin <= x < end), None)
            found = aligned(c, chars[begin:end], lo - begin, 4 * k_ + 2, k_) if same is None else (0, same - begin, same - begin + len(c))
            if found is None:
                continue
            distance, start, stop = found
            hit = (int(text[begin]), int(self.item[p]))
            if hit not in out or (distance, begin + start) < out[hit][:2]:
                out[hit] = (distance, begin + start, begin + stop)
        return [(*hit, *x) for hit, x in out.items()]


def aligned(item: np.ndarray, chars: np.ndarray, low: int, width: int, most: int) -> tuple[int, int, int] | None:
    """Best alignment of the whole item with a stretch of chars whose diagonals are in low .. low + width.

    Returns (edits, start, end), or None if every one needs more than `most`.
    Row i holds, for each diagonal d, the least edits of item[:i] against a
    stretch that ends at place i + low + d.
    """
    n, far = len(item), 1 << 20
    d = np.arange(width + 1)
    at = low + d
    cost = np.where((at >= 0) & (at <= len(chars)), 0, far)
    origin = at.copy()
    padded = np.full(n + width + 2, np.uint32(0xFFFFFFFF))
    lo, hi = max(0, low), min(len(chars), low + n + width)
    if hi > lo:
        padded[lo - low : hi - low] = chars[lo:hi]
    for i in range(n):
        same = cost + (padded[d + i] != item[i])
        skip = np.append(cost[1:] + 1, far)
        up = skip < same
        best, came = np.where(up, skip, same), np.where(up, np.append(origin[1:], 0), origin)
        at_end = low + i + 1 + d
        best = np.where((at_end >= 0) & (at_end <= len(chars)), best, far)
        # Insertions along the row: a running minimum.
        run = np.minimum.accumulate((best - d) * (width + 2) + d)
        from_ = run % (width + 2)
        cost, origin = (run - from_) // (width + 2) + d, came[from_]
        if cost.min() > most:
            return None
    e = int(np.argmin(cost))
    return (int(cost[e]), int(origin[e]), int(low + n + e)) if cost[e] <= most and origin[e] >= 0 else None


def _searched(index: Index, values: list[str | None]) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in values]
    lo = 0
    while lo < len(values):
        run, first, size = [], [], 0
        hi = lo
        while hi < len(values) and (hi == lo or size < SLICE_CHARS):
            plain = normalised(values[hi])
            c = codes(plain)
            out[hi] += [{"item_id": i, "distance": 0, "start": a, "end": b} for i, a, b in index.unedited(plain)]
            first.append(size)
            run += [c, np.array([0x110000], np.uint32)]
            size += len(c) + 1
            hi += 1
        chars = np.concatenate(run)
        text = np.repeat(np.arange(lo, hi), np.diff([*first, size]))
        text[np.append(np.array(first[1:], np.int64), size) - 1] = -1
        for t, item, distance, start, end in index.search(chars, text):
            base = first[t - lo]
            out[t].append({"item_id": item, "distance": distance, "start": start - base, "end": end - base})
        lo = hi
    return [sorted(h, key=lambda x: x["item_id"]) for h in out]


def searcher(shared: Broadcast) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            yield pa.array(_searched(shared.value, array.to_pylist()), kind)

    return search


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "hits") -> DataFrame:
    """Adds an array of hits (item_id, distance, start, end in normalised characters), empty for clean texts.

    Items are dealt to as many blocks as their characters ask for; each block's
    index has a bounded size and is broadcast. Of several blocks, one at a time
    is searched for in all texts, and the hits of its texts are written. A null
    or empty text has no hit, and neither has an item that is null or empty.
    Hits of one item are merged into the best one. An input column called like
    the output is replaced.
    """
    spark = docs.sparkSession
    send_package(spark)
    total = benchmark.agg(F.coalesce(F.sum(F.length(item_text)), F.lit(0)).alias("n")).first()["n"]
    blocks = -(-int(total) // BLOCK_CHARS)
    if not blocks:
        return docs.withColumn(out, F.array().cast(HITS))

    def index(b: int) -> Broadcast:
        part = benchmark.where(F.col(item).isNotNull() & (F.pmod(F.xxhash64(item), F.lit(blocks)) == b)).select(F.col(item).cast("long"), item_text)
        return spark.sparkContext.broadcast(Index.of(sorted((r[0], r[1] or "") for r in part.toLocalIterator())))

    if blocks == 1:
        return docs.withColumn(out, F.arrow_udf(HITS)(searcher(index(0)))(F.col(text)))
    found = None
    for b in range(blocks):
        shared = index(b)
        hits = docs.select(F.xxhash64(text).alias("text_id_"), F.arrow_udf(HITS)(searcher(shared))(F.col(text)).alias("hits_")).where(F.size("hits_") > 0)
        hits = written(hits, "hits")
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    # Equal texts have equal hits.
    merged = found.select("text_id_", F.explode("hits_").alias("hit_")).distinct().groupBy("text_id_").agg(F.sort_array(F.collect_list("hit_")).alias("hits_"))
    rows = docs.drop(out).withColumn("text_id_", F.xxhash64(text)).join(merged, "text_id_", "left")
    return rows.withColumn(out, F.coalesce("hits_", F.array().cast(HITS))).drop("text_id_", "hits_")


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a passage within the edit budget of a benchmark item, one row per document and item.

    Clean documents give no row. An empty table gives an empty result; repeated
    rows are reported as often as they occur.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = with_hits(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "hits").where(F.size("hits") > 0)
    return hits.select("doc_id", F.inline("hits")).withColumnsRenamed({"start": "start_char", "end": "end_char"})
