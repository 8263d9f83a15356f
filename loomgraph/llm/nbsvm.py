"""Quality classifier: naive Bayes support vectors.

Indicators of hashed n-grams are scaled by the log-count ratio of the two
classes; a linear hinge-loss model over them is fitted by dual coordinate
descent, and its margin is turned into a probability by a sigmoid that is
fitted on margins of rows left out. Only the fit sees labels, and only from a
sample of stated size; every text is scored whole, where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import python_batches, send_package, table
from loomgraph.llm.textcodes import Words, mix, slices, texts

#: Labelled rows that the fit uses at most; those of the smallest id hashes.
FIT_ROWS = 4000
#: Bits of a hashed n-gram.
BITS = 20
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12
FOLDS = 3
THRESHOLD = 0.3
SEED = 7
#: A model as a row; the arrays are 32-bit floats.
MODEL = "weights binary, ratio binary, bias double, slope double, shift double"


@dataclass
class Model:
    weights: np.ndarray  # of the scaled indicators
    ratio: np.ndarray  # log-count ratios
    bias: float
    slope: float
    shift: float


def _shape(w: Words) -> np.ndarray:
    """Kind of each word: bits for lower, upper, digit and other first bytes and last bytes, and its length class."""
    kind = np.full(256, 3, np.uint64)
    kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
    kind[128:] = 0
    size = np.minimum(w.end - w.start, 16).astype(np.uint64) // np.uint64(4)
    one, two = kind[w.raw[w.start]], kind[w.raw[w.end - 1]]
    mid = kind[w.raw[(w.start + w.end - 1) // 2]]
    return one | two << np.uint64(2) | mid << np.uint64(4) | size << np.uint64(6)


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed n-grams of each text: (text, n-gram), sorted.

    N-grams are words, word pairs, last three bytes of a word, and pairs and
    triples of word kinds, where a word equal to the one before is a kind of
    its own.
    """
    w = Words(data, at, lower=True)
    n = len(w.code)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.ones(n, bool)
    first[1:] = w.text[1:] != w.text[:-1]
    prev = np.concatenate([[np.uint64(1)], w.code[:-1]])
    prev[first] = 1
    raw = w.raw
    last = lambda k: np.where(w.end - w.start >= k, raw[np.maximum(w.end - k, 0)], 0).astype(np.uint64)
    tail = last(1) | last(2) << np.uint64(8) | last(3) << np.uint64(16)
    kind = _shape(w) | (w.code == prev).astype(np.uint64) << np.uint64(10)
    one = np.concatenate([[np.uint64(0)], kind[:-1]])
    one[first] = 2047
    two = np.concatenate([[np.uint64(0)], one[:-1]])
    two[first] = 2047
    grams = [w.code, mix(w.code + prev * np.uint64(3)), mix(tail + np.uint64(1 << 40)), mix(kind | one << np.uint64(11) | np.uint64(1 << 41)), mix(kind | one << np.uint64(11) | two << np.uint64(22) | np.uint64(1 << 42))]
    text = w.text.astype(np.uint64) << np.uint64(BITS)
    keys = np.unique(np.concatenate([text | g >> np.uint64(64 - BITS) for g in grams]))
    return (keys >> np.uint64(BITS)).astype(np.int64), (keys & np.uint64((1 << BITS) - 1)).astype(np.int64)


def margins(model: Model, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Margin of each text; a text without words has the bias alone."""
    text, gram = features(data, at)
    n = len(at) - 1
    dot = np.bincount(text, weights=model.weights[gram] * model.ratio[gram], minlength=n)
    norm = np.sqrt(np.bincount(text, weights=model.ratio[gram] ** 2, minlength=n))
    return dot / np.maximum(norm, 1e-9) + model.bias


def descend(rows: list[np.ndarray], scaled: list[np.ndarray], sign: np.ndarray, size: int, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge loss, by dual coordinate descent over rows of unit length."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    top = COST * len(sign) / (2 * np.array([max(1, (sign < 0).sum()), max(1, (sign > 0).sum())]))
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            y, x, v = sign[i], rows[i], scaled[i]
            slack = y * (w[x] @ v + bias) - 1.0
            new = min(max(alpha[i] - slack / 2.0, 0.0), top[int(y > 0)])
            step = (new - alpha[i]) * y
            if step:
                w[x] += step * v
                bias += step
                alpha[i], moved = new, max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """Model of the rows (each the n-grams of one text) and their labels 0 or 1.

    Without rows of both classes, the score is the share of label 1 (one half
    without any row).
    """
    size = 1 << BITS
    good = int((labels == 1).sum())
    if not good or good == len(labels):
        p = min(max((good + 0.5) / (len(labels) + 1.0), 1e-3), 1 - 1e-3)
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 1.0, float(np.log(p / (1 - p))))
    ratio = np.zeros(size)
    for c, way in ((1, 1.0), (0, -1.0)):
        count = np.full(size, SMOOTHING)
        for i in np.flatnonzero((labels == 1) == c):
            count[rows[i]] += 1.0  # the n-grams of a row are distinct
        count /= count.sum()
        ratio += way * np.log(count, out=count)
    # One array for all rows: thousands of small ones would leave the driver's memory in pieces.
    ends = np.cumsum([len(r) for r in rows])
    scaled = np.split(np.zeros(ends[-1], np.float32), ends[:-1])
    for r, s in zip(rows, scaled, strict=True):
        v = ratio[r]
        s[:] = v / max(float(np.sqrt(v @ v)), 1e-9)
    sign, rng = np.where(labels == 1, 1.0, -1.0), np.random.default_rng(SEED)
    fold, out = np.arange(len(rows)) % FOLDS, np.zeros(len(rows))
    for f in range(FOLDS):
        into = np.flatnonzero(fold != f)
        w, b = descend([rows[i] for i in into], [scaled[i] for i in into], sign[into], size, rng)
        for i in np.flatnonzero(fold == f):
            out[i] = w[rows[i]] @ scaled[i] + b
    slope, shift = sigmoid(out, labels)
    w, b = descend(rows, scaled, sign, size, rng)
    return Model(w.astype(np.float32), ratio.astype(np.float32), b, slope, shift)


def sigmoid(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the likeliest sigmoid, by Newton steps with smoothed targets."""
    good, bad = float((labels == 1).sum()), float((labels != 1).sum())
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x, theta = np.stack([margin, np.ones_like(margin)]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)) @ x.T + 1e-6 * np.eye(2), x @ (p - target) + 1e-6 * theta)
        theta = theta - np.clip(step, -2, 2)
    return float(theta[0]), float(theta[1])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the model of all rows (y, grams)."""
    grams, labels = [], []
    for batch in batches:
        column = batch.column("grams")
        if len(column):
            grams += np.split(column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())[:-1])
        labels += batch.column("y").to_pylist()
    m = fit(grams, np.array(labels, np.int32))
    row = {"weights": m.weights.tobytes(), "ratio": m.ratio.tobytes(), "bias": m.bias, "slope": m.slope, "shift": m.shift}
    yield pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> Model:
    """Fits on the labelled documents of the FIT_ROWS smallest hashes of the key.

    Rows with a null key, or a label other than 0 and 1, are left out. The
    sample is bounded, so its keys are broadcast and one task fits its n-grams;
    only the model, of fixed size, comes to the driver. Of keys that repeat,
    FIT_ROWS rows in all are used.
    """
    spark = docs.sparkSession
    some = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("k_"), F.col(label).cast("int").alias("y_"))
    some = some.orderBy(F.md5(F.col("k_").cast("string")), "k_", "y_").limit(FIT_ROWS)
    joined = docs.select(F.col(key).alias("k_"), F.col(text).alias("t_")).join(F.broadcast(some), "k_").select("k_", "y_", "t_")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = texts(batch.column("t_"))
            found = []
            for lo, hi in slices(at):
                of, gram = features(data, at[lo : hi + 1])
                found += np.split(gram.astype(np.int32), np.searchsorted(of, np.arange(1, hi - lo)))
            yield pa.RecordBatch.from_arrays([batch.column("k_").cast(pa.string()), batch.column("y_"), pa.array(found, pa.list_(pa.int32()))], names=["k", "y", "grams"])

    sample = joined.mapInArrow(rows, "k string, y int, grams array<int>").orderBy("k", "y", F.xxhash64("grams")).limit(FIT_ROWS)
    with python_batches(spark):
        made = sample.coalesce(1).mapInArrow(_fitted, MODEL).toArrow().to_pylist()
    if not made:
        return fit([], np.zeros(0, np.int32))
    return Model(**made[0] | {c: np.frombuffer(made[0][c], np.float32) for c in ("weights", "ratio")})


def scored(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score (0 to 1, higher: label 1 likelier). A null text counts as empty. Replaces an input column of that name."""
    send_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for array in batches:
            data, at = texts(array)
            found = [margins(m, data, at[lo : hi + 1]) for lo, hi in slices(at)]
            x = np.concatenate(found) if found else np.zeros(0)
            yield pa.array(1 / (1 + np.exp(-np.clip(m.slope * x + m.shift, -30, 30))))

    return docs.withColumn(out, score(F.col(text)))


def learnable(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The labels that the fit may see: those whose CRC-32 of the id as text isn't divisible by 5."""
    return labels.where(F.crc32(F.col(key).cast("string").cast("binary")) % 5 != 0)


def op7_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learnt from the labels outside the held-out fifth.

    A null doc_id is never held out. Empty and null texts get the score of a
    text without n-grams. An empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, learnable(table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
