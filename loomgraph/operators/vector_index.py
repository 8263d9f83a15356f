"""A stored inverted file of vectors: cells around centroids, probed best first, with an exact way beside it.

Centroids are fitted by spherical k-means on a bounded sample; every vector is
indexed, in the cell of its nearest centroid, in files ordered by cell. A
search by `probes` cells reads these alone. The exact way reads them too, and
then each further cell whose largest angle to its centroid leaves room for a
vector as near as the k-th one found.

Cells and their queries meet in blocks of bounded size, so neither a large cell
nor one that many queries ask for comes to one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.session import send_package

#: Vectors that centroids are fitted on, those of the least hashes of the id; most centroids; rounds of fitting.
SAMPLE, MOST_CELLS, ROUNDS = 20_000, 1024, 8
#: Vectors, and queries, of a cell that meet in one task.
BLOCK = 4096
#: Rows that are compared with all centroids at once.
ROWS_COMPARED = 256
#: Share of the cells that the approximate search probes, at least one: vectors without clusters need so many for a recall of 0.9, clustered ones a tenth.
PROBED = 0.75
CELLS = "cell int, centroid array<double>, n long, reach double"
FOUND = "query_id long, id long, sim double"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Batches in parts of few rows: each row is compared with all centroids, so a whole batch would make a matrix of its rows times these."""
    for array in batches:
        for lo in range(0, len(array), ROWS_COMPARED):
            yield array.slice(lo, ROWS_COMPARED)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]


def fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of unit vectors: farthest-first seeds, then rounds of spherical k-means."""
    x = _unit(sample)
    seeds, near = [0], x @ x[0]
    while len(seeds) < min(cells, len(x)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(ROUNDS):
        of = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        some = np.linalg.norm(sums, axis=1) > 1e-12
        c[some] = _unit(sums[some])
    return c


def _met(vectors: pa.Table, queries: pa.Table, k: int, least: float) -> pa.Table:
    """The k nearest of a block of vectors for each of a block of queries; a query's own id is left out."""
    ids, asked = vectors.column("id").to_numpy(), queries.column("query_id").to_numpy()
    if not len(ids) or not len(asked):
        return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
    v, q = _matrix(vectors.column("embedding")), _matrix(queries.column("embedding"))
    out = []
    for lo in range(0, len(q), 256):
        a, mine = q[lo : lo + 256], asked[lo : lo + 256]
        sims = np.round((a @ v.T) / np.maximum(np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(v, axis=1)), 1e-300), 6)
        sims[mine[:, None] == ids[None, :]] = -2.0
        floor = np.maximum(queries.column("least").to_numpy()[lo : lo + 256], least)
        if sims.shape[1] > k:
            floor = np.maximum(floor, np.partition(sims, -k, axis=1)[:, -k])
        i, j = np.nonzero(sims >= floor[:, None])  # ties with the k-th included
        order = np.lexsort((ids[j], -sims[i, j], i))
        i, j = i[order], j[order]
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        place = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))
        out.append((mine[i[place < k]], ids[j[place < k]], sims[i[place < k], j[place < k]]))
    a, b, s = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table({"query_id": a, "id": b, "sim": s})


class VectorIndex:
    """The index in a folder. Vectors are id and embedding, all of one length; those that are null aren't indexed."""

    def __init__(self, spark: SparkSession, folder: str):
        send_package(spark)
        self.spark, self.folder = spark, folder.rstrip("/")

    def build(self, vectors: DataFrame, cells: int | None = None) -> None:
        """Fits the centroids and writes all vectors; by default there are about as many cells as the root of the rows, at most 1,024."""
        rows = vectors.where("id is not null and embedding is not null").select(F.col("id").cast("long"), F.col("embedding").cast("array<double>"))
        sample = _matrix(rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow().column("embedding"))
        n = rows.count()
        centroids = fitted(sample, max(1, min(MOST_CELLS, cells or int(n**0.5)))) if len(sample) else np.zeros((0, 1))

        def placed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            kind = pa.struct([("cell", pa.int32()), ("away", pa.float64())])
            for array in _parts(batches):
                near = np.clip(_unit(_matrix(array)) @ centroids.T, -1, 1) if len(array) else np.zeros((0, 1))
                cell = near.argmax(axis=1)
                yield pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(np.arccos(near[np.arange(len(cell)), cell]))], fields=list(kind))

        at = rows.withColumn("at", F.arrow_udf("struct<cell:int,away:double>")(placed)("embedding")).select("id", "embedding", "at.cell", "at.away")
        at.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.parquet(f"{self.folder}/vectors")
        sizes = self.vectors().groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("reach"))
        known = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
        known.join(sizes, "cell").select("cell", "centroid", "n", "reach").coalesce(1).write.parquet(f"{self.folder}/cells")

    def vectors(self) -> DataFrame:
        return self.spark.read.schema("id long, embedding array<double>, cell int, away double").parquet(f"{self.folder}/vectors")

    def _asked(self, queries: DataFrame) -> tuple[DataFrame, int]:
        """For each query and cell: the similarity of the centroid, the best that a vector of the cell can have, and the cell's rank by that of centroids."""
        cells = self.spark.read.schema(CELLS).parquet(f"{self.folder}/cells").orderBy("cell").toArrow()  # at most MOST_CELLS rows
        centroids, reach, number = _matrix(cells.column("centroid")), cells.column("reach").to_numpy(), cells.column("cell").to_numpy()

        def ranked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            kind = pa.struct([("cell", pa.int32()), ("best", pa.float64()), ("place", pa.int32())])
            for array in _parts(batches):
                near = np.clip(_unit(_matrix(array)) @ centroids.T, -1, 1) if len(array) else np.zeros((0, len(number)))
                best = np.cos(np.maximum(np.arccos(near) - reach, 0)) + 1e-6
                place = (-near).argsort(axis=1, kind="stable").argsort(axis=1)
                flat = pa.StructArray.from_arrays([pa.array(np.tile(number, len(near)).astype(np.int32)), pa.array(best.ravel()), pa.array(place.ravel().astype(np.int32))], fields=list(kind))
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * len(number), pa.int32()), flat)

        rows = queries.where("id is not null and embedding is not null").select(F.col("id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>"))
        kind = "array<struct<cell:int,best:double,place:int>>"
        return rows.withColumn("cells", F.arrow_udf(kind)(ranked)("embedding")).select("query_id", "embedding", F.inline("cells")), len(number)

    def _search(self, asked: DataFrame, k: int, least: float) -> DataFrame:
        """Best rows of the asked cells: asked has query_id, embedding, cell and least."""
        sizes = self.spark.read.schema(CELLS).parquet(f"{self.folder}/cells").select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("rows_"))
        load = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("asks_"))
        grid = F.broadcast(load.join(F.broadcast(sizes), "cell"))  # a row a cell
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        key = ("cell", "vb", "qb")
        vectors = self.vectors().join(grid, "cell").withColumn("vb", F.pmod(F.xxhash64("id"), F.col("rows_")).cast("int")).withColumn("qb", upto("asks_")).select(*key, "id", "embedding")
        queries = asked.join(grid, "cell").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("asks_")).cast("int")).withColumn("vb", upto("rows_")).select(*key, "query_id", "embedding", "least")
        return vectors.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(lambda v, q: _met(v, q, k, least), FOUND)

    def nearest(self, queries: DataFrame, k: int, min_similarity: float = -1.0, exact: bool = True, probed: float = PROBED) -> DataFrame:
        """For each query (id, embedding), its k nearest other vectors: query_id, id, sim, rank; ties go to the smaller id.

        The approximate search probes that share of the cells; the exact one
        goes on as long as a cell may hold a nearer vector.
        """
        asked, n = self._asked(queries)
        if not n:
            return self.spark.createDataFrame([], f"{FOUND}, rank int")
        probes = max(1, int(np.ceil(n * probed)))
        first = asked.where(F.col("place") < probes).withColumn("least", F.lit(float(min_similarity)))
        found = self._search(first, k, min_similarity).checkpoint()
        order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
        best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if not exact:
            return best(found)
        worst = best(found).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("sim")).alias("worst"))
        rest = asked.where(F.col("place") >= probes).join(worst, "query_id", "left").withColumn("least", F.greatest(F.coalesce("worst", F.lit(min_similarity)), F.lit(float(min_similarity))))
        return best(found.unionByName(self._search(rest.where("best >= least"), k, min_similarity)))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: n_wanted, the rows of the exact search, and n_found, those of them that the other one has."""
    hits = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.agg(F.count(F.lit(1)).alias("n_wanted"), F.count("hit").alias("n_found"))
