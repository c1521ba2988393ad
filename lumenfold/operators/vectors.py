"""Nearest vectors by cosine: a stored inverted file of cells around centroids, with probing, and the exact way beside it.

The centroids are fitted by k-means on a bounded sample, which also tells how many cells have to be probed; every vector is assigned to its nearest one and stored in the folder of
its cell. A query reads the cells of its nearest centroids: folders, so that the others are not even listed by the scan. With
all cells probed the answer is exact, as is a scan of the unindexed table (``exact``), which runs the same code.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lumenfold.operators.fulltext import put
from lumenfold.operators.relational import ship

#: Vectors the centroids are fitted on, chosen by a hash of their ids, whatever the number of vectors: the documented bound.
SAMPLE = 20_000
#: Most cells; the centroids are broadcast (8 bytes a dimension each).
MOST_CELLS = 4096
#: Queries that are broadcast together.
BLOCK = 4096
#: Share of the TRIED sampled vectors' DEPTH nearest in the sample that the probed cells have to hold.
TARGET, TRIED, DEPTH = 0.93, 256, 50


def matrix(column: pa.Array) -> np.ndarray:
    """A row for each list of numbers, of unit length; a list of zeros stays one."""
    lengths = {len(v) for v in column if v.is_valid} if column.null_count else set(np.unique(np.diff(column.offsets.to_numpy())).tolist())
    if len(lengths) > 1:
        raise ValueError("vectors of several lengths")
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def held(vectors: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """(id, embedding, carried) of the rows that have a vector with a direction: not null, not empty, not all zeros."""
    return vectors.where(F.exists("embedding", lambda x: x != 0)).select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), *carried)


def sampled(vectors: DataFrame, seed: int = 5) -> np.ndarray:
    """At most SAMPLE unit vectors."""
    chosen = held(vectors).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()
    if not len(chosen):
        return np.zeros((0, 1))
    return matrix(chosen.chunk(0) if isinstance(chosen, pa.ChunkedArray) else chosen)


def centroids(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centres of at most so many cells, of unit length: spherical k-means."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    draw = np.random.default_rng(seed)
    centre = x[np.sort(draw.choice(len(x), min(cells, len(x)), replace=False))]
    for _ in range(rounds):
        nearest = (x @ centre.T).argmax(1)
        sums = np.zeros_like(centre)
        np.add.at(sums, nearest, x)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        centre = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centre)  # an empty cell stays where it is
    return centre


def needed(x: np.ndarray, centre: np.ndarray) -> int:
    """How many of the nearest cells hold TARGET of the DEPTH nearest vectors, over TRIED of the sample: few where vectors
    gather, more than half of the cells where they lie in all directions alike."""
    if not len(x):
        return 1
    tried = x[np.linspace(0, len(x) - 1, min(TRIED, len(x))).astype(int)]
    near = np.argpartition(-(tried @ x.T), min(DEPTH, len(x)) - 1, 1)[:, :DEPTH]
    order = np.argsort(np.argsort(-(tried @ centre.T), 1, kind="stable"), 1)
    places = np.sort(np.take_along_axis(order, (x @ centre.T).argmax(1)[near], 1).reshape(-1))
    return int(places[int(np.ceil(TARGET * len(places))) - 1]) + 1


def best(rows: Iterator[pa.RecordBatch], queries: tuple[np.ndarray, np.ndarray, list[set[int]] | None], k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, id, score): the k best of each batch (id, embedding[, cell]) for each query that probes the batch's cells."""
    ids, q, probed = queries
    for b in rows:
        if not len(b):
            continue
        x, own = matrix(b.column(1)), b.column(0).to_numpy()
        parts = [(np.arange(len(ids)), np.arange(len(x)))]
        if probed is not None:
            cell = b.column(2).to_numpy()
            parts = [(np.array([i for i, cells in enumerate(probed) if c in cells], np.int64), np.flatnonzero(cell == c)) for c in np.unique(cell).tolist()]
        for asked, at in parts:
            if not len(asked):
                continue
            score = np.round(q[asked] @ x[at].T, 6)
            order = np.lexsort((np.broadcast_to(own[at], score.shape), -score), 1)[:, :k]
            n = order.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[asked], n)), pa.array(own[at][order].reshape(-1)), pa.array(np.take_along_axis(score, order, 1).reshape(-1))], ["query_id", "id", "score"])


def nearest_of(rows: DataFrame, queries: tuple[np.ndarray, np.ndarray, list[set[int]] | None], k: int) -> DataFrame:
    """(query_id, rank, id, score) of the k nearest rows of each query; ties by id. ``queries``: at most BLOCK."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(queries)
    found = rows.mapInArrow(lambda batches: best(batches, shared.value, k), "query_id long, id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place.cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of the queries (id, embedding), BLOCK at a time; they come to the driver one partition after another."""
    ids: list[int] = []
    rows: list[list[float]] = []
    for r in held(queries).toLocalIterator():
        ids.append(r.id)
        rows.append(r.embedding)
        if len(ids) == BLOCK:
            yield np.array(ids, np.int64), matrix(pa.array(rows, pa.list_(pa.float64())))
            ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), matrix(pa.array(rows, pa.list_(pa.float64())))


def _all(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    out = spark.createDataFrame([], "query_id long, rank long, id long, score double")
    for p in parts:
        out = out.union(p)
    return out


def exact(vectors: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """(query_id, rank, id, score): the k nearest of all vectors (id, embedding) for each query (id, embedding), by a scan for each
    block of queries. Rows without a direction are no candidates and no queries."""
    rows = held(vectors)
    return _all([nearest_of(rows, (ids, q, None), k) for ids, q in blocks(queries)], vectors.sparkSession)


class VectorIndex:
    """An inverted file at ``path``: ``centroids`` (cell, centre, and how many cells are probed) and ``cells``, a folder for each."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        found = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
        self.centres, self.probed = np.array([r.centre for r in found]), found[0].probed
        self.rows = spark.read.parquet(f"{path}/cells")

    @classmethod
    def write(cls, vectors: DataFrame, path: str, cells: int | None = None, carried: Sequence[str] = ()) -> VectorIndex:
        """Of vectors (id, embedding, carried), all that are there. Without a number of cells there are about as many as a cell has
        vectors, MOST_CELLS at most. A cell's vectors are spread over files by id. An index that is there stays."""
        spark = vectors.sparkSession
        ship(spark)
        own = f"{path}.{uuid.uuid4().hex}"
        rows = held(vectors, carried)
        cells = cells or min(MOST_CELLS, max(1, round(rows.count() ** 0.5)))
        x = sampled(vectors)
        centre = centroids(x, cells)
        probed = needed(x, centre)
        shared = spark.sparkContext.broadcast(centre)

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = (matrix(b.column(1)) @ shared.value.T).argmax(1) if len(b) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], [*b.schema.names, "cell"])

        schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
        placed = rows.mapInArrow(assigned, f"{schema}, cell int")
        placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.partitionBy("cell").parquet(f"{own}/cells")
        spark.createDataFrame([(i, c.tolist(), probed) for i, c in enumerate(centre)], "cell int, centre array<double>, probed int").coalesce(1).write.parquet(f"{own}/centroids")
        put(spark, own, path)
        return cls(spark, path)

    def probes(self, q: np.ndarray, n: int | None) -> list[set[int]]:
        """The cells of each query's n nearest centroids; all cells without a number."""
        order = np.argsort(-(q @ self.centres.T), 1, kind="stable")[:, :n]
        return [set(r.tolist()) for r in order]

    def _found(self, ids: np.ndarray, q: np.ndarray, k: int, n: int | None, where: Column | None) -> DataFrame:
        probed = self.probes(q, n)
        rows = self.rows if n is None else self.rows.where(F.col("cell").isin(sorted(set().union(*probed))))
        rows = rows if where is None else rows.where(where)
        return nearest_of(rows.select("id", "embedding", "cell"), (ids, q, probed), k)

    def search(self, queries: DataFrame, k: int = 50, n: int | None = 0, where: Column | None = None) -> DataFrame:
        """(query_id, rank, id, score) of the k nearest in the n cells nearest to each query (id, embedding); n = 0: as many as
        the sample called for (``needed``), None: all, which is exact. ``where``: a predicate on carried columns."""
        n = self.probed if n == 0 else n
        return _all([self._found(ids, q, k, n, where) for ids, q in blocks(queries)], self.spark)

    def nearest(self, vector: Sequence[float], k: int = 50, where: Column | None = None, n: int | None = 0) -> DataFrame:
        """(rank, id, score) for one vector."""
        q = matrix(pa.array([list(vector)], pa.list_(pa.float64())))
        return self._found(np.array([0]), q, k, self.probed if n == 0 else n, where).select("rank", "id", "score")


def recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(queries, recall) of lists (query_id, id): the share of the wanted ids that were found, over all queries."""
    hit = wanted.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.countDistinct("query_id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
