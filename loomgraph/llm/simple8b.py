"""Token ids in Simple-8b words.

A 64-bit word holds a selector in its top 4 bits and as many ids as fit in the
other 60. An id of 60 bits or more follows an escape word as a raw word. Ids
are coded in blocks of 1,024, whose word offsets are kept, so that any block is
decoded alone and all blocks of a row at once.

The file format is Parquet with one row per run of documents in ascending
order: part, row, start_in_part, doc_ids, n_tokens, n_ids, words (binary,
little-endian), block_offsets, raw_at (places of raw words).
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import python_batches, send_package, shared_dir, table

#: Ids in a word and bits of each, by selector 0 to 13; 15 is the escape.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
BLOCK = 1024
#: Ids at which a row of the file is closed.
ROW_IDS = 1 << 18
END_ID = 2
FILE_SCHEMA = "part int, row long, start_in_part long, doc_ids array<long>, n_tokens array<long>, n_ids long, words binary, block_offsets array<int>, raw_at array<int>"
#: Pieces whose ids a worker process remembers before it starts anew.
REMEMBERED = 1_000_000
#: Characters that are tried for letters: Latin, Greek and Cyrillic ones.
LETTERS = range(0x41, 0x530)
#: Bytes of text that are encoded at once, a longer text alone.
AT_ONCE = 1_000_000
#: Bits of each number below 2^16.
_SMALL = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, block_offsets, raw_at) of 64-bit unsigned ids: greedy, the fullest word first."""
    n = len(ids)
    rows = -(-n // BLOCK)
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    wide = np.zeros((rows, BLOCK + 60), np.uint64)
    flat = np.zeros(rows * BLOCK, np.uint64)
    flat[:n] = ids
    wide[:, :BLOCK] = flat.reshape(rows, BLOCK)
    if int(ids.max()) < len(_SMALL):
        need = _SMALL[wide]
    else:
        need = np.zeros(wide.shape, np.uint8)
        for b in range(60):
            need[wide >= np.uint64(1 << b)] = b + 1
        need[wide >= np.uint64(1 << 60)] = 61
    most, of = {1: need}, lambda c, at: np.pad(most[c][:, at:], ((0, 0), (0, at)))
    for c, a, b in ((2, 1, 1), (3, 2, 1), (4, 2, 2), (5, 4, 1), (6, 4, 2), (7, 4, 3), (8, 4, 4), (10, 8, 2), (12, 8, 4), (15, 8, 7), (20, 12, 8), (30, 15, 15), (60, 30, 30)):
        most[c] = np.maximum(most[a], of(b, a))
    pick = np.full(wide.shape, ESCAPE, np.uint8)
    for s in range(len(COUNTS) - 1, -1, -1):
        np.minimum(pick, (most[COUNTS[s]] > BITS[s]).view(np.uint8) * np.uint8(ESCAPE) | np.uint8(s), out=pick)
    takes = np.array([*COUNTS, 0, 1], np.int64)
    ends = np.full(rows, BLOCK, np.int64)
    ends[-1] = n - (rows - 1) * BLOCK
    at, taken, flat_pick = np.arange(rows) * wide.shape[1], np.zeros(wide.size, bool), pick.ravel()
    ends += at
    while len(at):
        taken[at] = True
        at = at + takes[flat_pick[at]]
        left = at < ends
        at, ends = at[left], ends[left]
    source, base = wide.ravel(), np.flatnonzero(taken)
    row, sel = base // wide.shape[1], flat_pick[base]
    coded = sel.astype(np.uint64) << np.uint64(60)
    for s, (c, b) in enumerate(zip(COUNTS, BITS, strict=True)):
        m = np.flatnonzero(sel == s)
        first, word = base[m], np.zeros(len(m), np.uint64)
        for k in range(c if len(m) else 0):
            word |= source[first + k] << np.uint64(b * k)
        coded[m] |= word
    raw = sel == ESCAPE
    where = np.arange(len(sel)) + np.cumsum(raw) - raw
    words = np.zeros(len(sel) + int(raw.sum()), np.uint64)
    words[where] = coded
    raw_at = where[raw] + 1
    words[raw_at] = source[base[raw]]
    return words, where[np.searchsorted(row, np.arange(rows))].astype(np.int32), raw_at.astype(np.int32)


def unpack(words: np.ndarray, block_offsets: np.ndarray, raw_at: np.ndarray, n: int) -> np.ndarray:
    """The n ids of the words; every block at once."""
    if not n:
        return np.zeros(0, np.uint64)
    head = np.ones(len(words), bool)
    head[raw_at] = False
    at = np.flatnonzero(head)
    sel = (words[at] >> np.uint64(60)).astype(np.int64)
    count = np.array([*COUNTS, 0, 1], np.int64)[sel]
    before = np.cumsum(count) - count
    first = np.searchsorted(at, block_offsets)
    block = np.repeat(np.arange(len(first)), np.diff([*first, len(at)]))
    base = block * (BLOCK + 60) + before - before[first][block]
    out = np.zeros(len(first) * (BLOCK + 60), np.uint64)
    for s, (c, b) in enumerate(zip(COUNTS, BITS, strict=True)):
        m = np.flatnonzero(sel == s)
        packed, to = words[at[m]], base[m]
        for k in range(c if len(m) else 0):
            out[to + k] = (packed >> np.uint64(b * k)) & np.uint64((1 << b) - 1)
    raw = sel == ESCAPE
    out[base[raw]] = words[at[raw] + 1]
    return out.reshape(len(first), BLOCK + 60)[:, :BLOCK].reshape(-1)[:n]


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces of texts begin, in UTF-8 bytes: places at which byte-level BPE with the usual letter, number, other and space pattern always starts anew.

    That is at a text's start; before white space after another character, seen
    at spaces and line feeds; after a line feed between two other characters;
    and before a full stop or comma after a letter, seen for the letters of ASCII
    and Latin-1. Where a character isn't told from white space by its bytes
    here, no cut is made.
    """
    mark = np.zeros(len(data) + 1, bool)
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[(at > 0) & (at < len(data))]
    last, second, third = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    blank = (last <= 32) | (second == 0xC2) & ((last == 0x85) | (last == 0xA0)) | (last >= 0x80) & ((third == 0xE1) & (second == 0x9A) | (third == 0xE2) & ((second == 0x81) | (second == 0x80) & ((last < 0x90) | (last >= 0xA8))) | (third == 0xE3) & (second == 0x80))
    after = at[~blank]
    mark[after] = True
    feeds = after[data[after] == 10] + 1
    feeds = feeds[feeds < len(data)]
    following = data[feeds]
    mark[feeds[(following > 32) & (following < 0x80) | (following >= 0xC3) & ~np.isin(following, (0xE1, 0xE2, 0xE3))]] = True
    at = np.flatnonzero((data == 44) | (data == 46))
    at = at[at > 0]
    last = data[at - 1]
    low = last | 32
    mark[at[(low >= 97) & (low <= 122) & (last < 0x80) | (data[np.maximum(at - 2, 0)] == 0xC3) & (last != 0x97) & (last != 0xB7) & (last >= 0x80)]] = True
    mark[starts] = True
    return np.flatnonzero(mark[:-1])


class PieceCoder:
    """Encodes texts with a `tokenizers` file; pieces met before keep their ids.

    At most REMEMBERED pieces are kept in mind, which bounds the memory.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        vocabulary = self.coder.get_vocab()
        #: Bytes of each token: a character stands for a byte, but in added tokens.
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [*map(len, vocabulary)]
        for i, token in self.coder.get_added_tokens_decoder().items():
            self.bytes_of[i] = len(token.content.encode())
        #: Of each letter, the characters that stand for its bytes. Pieces of letters alone go straight to the model, as nothing in them is split.
        split = self.coder.pre_tokenizer.pre_tokenize_str
        self.stands = {ord(c): split(c)[0][0] for c in map(chr, LETTERS) if len(split(f"a{c}a")) == 1} | {32: split(" a")[0][0][0]}
        self.letters = re.compile(f" ?[{re.escape(''.join(chr(i) for i in self.stands if i != 32))}]+")
        if self.coder.normalizer is not None or any(self.letters.fullmatch(t.content.strip()) for t in self.coder.get_added_tokens_decoder().values()):
            self.letters = re.compile("(?!)")  # then words aren't what they seem
        # Each word comes once, so the model's own memory would only cost time.
        self.model = self.coder.model
        self.model._resize_cache(0)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.first, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def learn(self, new: list[str]) -> None:
        """Adds unknown pieces."""
        words = [*filter(self.letters.fullmatch, new)]
        if words:
            flat: list[int] = []
            sizes = []
            for tokens in map(self.model.tokenize, "\n".join(words).translate(self.stands).split("\n")):
                flat += [t.id for t in tokens]
                sizes.append(len(tokens))
            self._keep(words, np.array(flat, np.int64), np.array(sizes, np.int64))
        if len(words) < len(new):
            self._encode([p for p in new if p not in self.known])

    def _ids(self, codes: np.ndarray) -> np.ndarray:
        size = self.size[codes]
        return self.ids[np.repeat(self.first[codes] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]

    def _keep(self, order: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        k, more = len(self.known), len(flat)
        for name, top in (("ids", self.used + more), ("first", k + len(order)), ("size", k + len(order))):
            old = getattr(self, name)
            if top > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(max(len(old), top - len(old)), old.dtype)]))
        self.ids[self.used : self.used + more] = flat
        self.first[k : k + len(order)] = self.used + np.cumsum(size) - size
        self.size[k : k + len(order)] = size
        self.used += more
        self.known.update(zip(order, range(k, k + len(order)), strict=True))

    def _encode(self, new: list[str]) -> None:
        # A piece that doesn't start with white space, or ends with it, is encoded alone; the others many at once.
        alone = [p for p in new if p[0] not in " \n" or p[-1].isspace()]
        apart = set(alone)
        many = [p for p in new if p not in apart]
        flat: list[np.ndarray] = []
        sizes = []
        if alone:
            each = [e.ids for e in self.coder.encode_batch_fast(alone, add_special_tokens=False)]
            flat += [np.array(x, np.int64) for x in each]
            sizes.append([*map(len, each)])
        for lo in range(0, len(many), 4096):
            some = many[lo : lo + 4096]
            whole = "".join(some)
            ids = np.array(self.coder.encode_batch_fast([whole], add_special_tokens=False)[0].ids, np.int64)
            starts = np.cumsum([0, *(map(len, some) if whole.isascii() else (len(p.encode()) for p in some))])
            at = np.cumsum(self.bytes_of[ids])
            if at[-1] == starts[-1]:
                at -= self.bytes_of[ids]
            else:  # a token whose text isn't what it stands for
                e = self.coder.encode(whole, add_special_tokens=False)
                ids, at = np.array(e.ids, np.int64), np.fromiter((x for x, _ in e.offsets), np.int64, len(e.ids))
                starts = np.cumsum([0, *map(len, some)])
            sizes.append(np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(some)))
            flat.append(ids)
        if new:
            self._keep([*alone, *many], np.concatenate(flat), np.concatenate(sizes).astype(np.int64))

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and the number of each text's ids. A null text counts as empty."""
        if len(self.known) > REMEMBERED:
            self.clear()
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).fill_null("").cast(pa.large_string())
        _, places, held = column.buffers()
        bounds = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(held or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        at = cuts(data, bounds[:-1])
        # Pieces are slices of the texts' own bytes; each different one is looked up once.
        found = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        different = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = np.fromiter(map(self.known.get, different, repeat(-1)), np.int64, len(different))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            new = [different[i] for i in missing]
            self.learn(new)
            codes[missing] = [self.known[p] for p in new]
        codes = codes[found.indices.to_numpy()]
        text = np.repeat(np.arange(len(column)), np.diff(np.searchsorted(at, bounds)))
        counts = np.bincount(text, weights=self.size[codes], minlength=len(column)).astype(np.int64) + 1
        plain = self._ids(codes)
        out = np.empty(len(plain) + len(column), np.uint32)
        ends = np.cumsum(counts) - 1
        inner = np.ones(len(out), bool)
        inner[ends] = False
        out[inner], out[ends] = plain, END_ID
        return out, counts


@lru_cache(maxsize=1)
def coder(path: str) -> PieceCoder:
    """The worker process's coder: what one task has met, the next ones know."""
    return PieceCoder(path)


def _file_rows(batches: Iterator[pa.RecordBatch], tokenizer_path: str) -> Iterator[pa.RecordBatch]:
    part, start, row = TaskContext.get().partitionId(), 0, 0
    keys: list[int | None] = []
    sizes: list[int] = []
    held: list[np.ndarray] = []
    n = 0

    def close() -> pa.RecordBatch:
        nonlocal start, row, keys, sizes, held, n
        words, offsets, raw_at = pack(np.concatenate(held).astype(np.uint64))
        out = [[part], [row], [start], [keys], [sizes], [n], [words.astype("<u8").tobytes()], [offsets.tolist()], [raw_at.tolist()]]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        start, row, keys, sizes, held, n = start + n, row + 1, [], [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=["part", "row", "start_in_part", "doc_ids", "n_tokens", "n_ids", "words", "block_offsets", "raw_at"])

    for batch in batches:
        texts, ids_of = batch.column("text").fill_null(""), batch.column("doc_id").to_pylist()
        before = np.cumsum([0, *pc.binary_length(texts).to_pylist()])
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(before, before[lo] + AT_ONCE, "right")) - 1)
            ids, counts = coder(tokenizer_path).encode(texts.slice(lo, hi - lo))
            ends = np.cumsum(counts)
            at, done = 0, 0
            while at < len(ends):
                to = min(len(ends), int(np.searchsorted(ends, done + ROW_IDS - n)) + 1)
                keys += ids_of[lo + at : lo + to]
                sizes += counts[at:to].tolist()
                held.append(ids[done : ends[to - 1]])
                n += int(ends[to - 1]) - done
                at, done = to, int(ends[to - 1])
                if n >= ROW_IDS:
                    yield close()
            lo = hi
    if keys:
        yield close()


def write(docs: DataFrame, tokenizer_path: str, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Encodes every whole text and writes the files in ascending key order.

    A null text counts as empty and has the end id alone; null keys come first;
    rows of equal keys are ordered by a hash of the text. The texts are dealt
    by ranges of the key, so a part of the files is a range of documents.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    with python_batches(docs.sparkSession):
        rows.mapInArrow(lambda it: _file_rows(it, tokenizer_path), FILE_SCHEMA).write.option("compression", "zstd").parquet(path)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"]
    for batch in batches:
        for r in batch.to_pylist():
            ids = unpack(np.frombuffer(r["words"], "<u8"), np.array(r["block_offsets"], np.int64), np.array(r["raw_at"], np.int64), r["n_ids"]).astype("<u4")
            counts = np.array(r["n_tokens"], np.int64)
            ends = np.cumsum(counts)
            sums = [zlib.crc32(ids[e - c : e].tobytes()) for e, c in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * len(sums), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(r["start_in_part"] + ends - counts, pa.int64()), pa.array(counts), pa.array(sums, pa.int64())], names=names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Decodes the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Where the parts begin follows from one total per part, a table of as many
    rows as there are files; nothing else is shuffled.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("part", before.cast("long").alias("part_start"))
    send_package(spark)
    rows = files.mapInArrow(_decoded, "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def op3_simple8b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written in Simple-8b words and read back.

    An empty table gives no files' rows and an empty result.
    """
    import public_tokenizers

    path = f"{shared_dir(spark).rstrip('/')}/loomgraph/ids-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read(spark, path)
