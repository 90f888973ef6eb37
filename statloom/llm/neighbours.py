"""Nearest neighbours by permutations: vectors are ordered lists of their nearest pivots, posted under each pivot."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIVOTS = 256  # a sample of the vectors
LISTED = 96  # nearest pivots a vector is posted under
SHARE = 0.1  # part of the rows, those with the smallest footrule distance, whose true distance is measured
FEWEST = 200  # but so many at least in each block
QUERIES = 5000  # queries that one pass answers


def _matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dim)


def _orders(vectors: np.ndarray, pivots: np.ndarray, listed: int) -> np.ndarray:
    """Numbers of the nearest pivots, nearest first, ties to the smaller number."""
    far = (pivots ** 2).sum(1)[None] - 2 * vectors @ pivots.T
    return np.argsort(far, axis=1, kind="stable")[:, :listed]


class _Postings:
    """The inverted file of one block of vectors: for each pivot who lists it, and at which rank."""

    def __init__(self, orders: np.ndarray, pivots: int):
        n, self.listed = orders.shape
        self.size = n
        by_pivot = np.argsort(orders.reshape(-1), kind="stable")
        self.row, self.rank = by_pivot // self.listed, by_pivot % self.listed
        self.limits = np.searchsorted(orders.reshape(-1)[by_pivot], np.arange(pivots + 1))

    def nearest(self, order: np.ndarray, count: int) -> np.ndarray:
        """Rows with the smallest footrule distance to a query's list, ties to earlier rows.

        With absent pivots at rank ``listed`` the distance is a constant minus 2 (listed - larger rank) for each shared
        pivot, so only the postings of the query's pivots are read.
        """
        gain = np.zeros(self.size, np.int64)
        for rank, pivot in enumerate(order):
            a, b = self.limits[pivot], self.limits[pivot + 1]
            gain[self.row[a:b]] += self.listed - np.maximum(self.rank[a:b], rank)
        key = np.arange(self.size) - gain * self.size
        return np.argpartition(key, count - 1)[:count] if count < self.size else np.arange(self.size)


def _search(shared, k: int, listed: int, share: float, fewest: int, dim: int):
    def run(batches):
        pivots, query_ids, queries = shared.value
        lists = _orders(queries, pivots, listed)
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(query_ids)
        for batch in batches:
            ids = np.asarray(batch.column(0), np.int64)
            order = np.argsort(ids, kind="stable")
            ids, vectors = ids[order], _matrix(batch.column(1), dim)[order]
            if not len(ids):
                continue
            postings = _Postings(_orders(vectors, pivots, listed), len(pivots))
            count = max(fewest, int(np.ceil(share * len(ids))))
            for q, (own, vector) in enumerate(zip(query_ids, queries)):
                rows = postings.nearest(lists[q], min(count + 1, len(ids)))
                rows = rows[ids[rows] != own]
                gap = vectors[rows] - vector
                score = np.concatenate((best[q][0], np.sqrt((gap * gap).sum(1))))
                names = np.concatenate((best[q][1], ids[rows]))
                first = np.lexsort((names, score))[:k]
                best[q] = score[first], names[first]
        sizes = [len(b[0]) for b in best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(query_ids, sizes)), pa.array(np.concatenate([b[1] for b in best])),
                 pa.array(np.concatenate([b[0] for b in best]))], ["query_id", "vec_id", "score"])
    return run


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that can be searched: an id, no null or non-finite component, not all zero.

    Of several lengths the most frequent one takes part (the larger if two are as frequent).
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    size = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return rows.filter(F.size("vector") == (size[0]["d"] if size else 0))


def nearest_neighbours(vectors: DataFrame, queries, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
                       pivots: int = PIVOTS, listed: int = LISTED, share: float = SHARE, fewest: int = FEWEST,
                       block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance in double precision) of the ``k`` nearest rows found.

    ``queries`` is a condition on the usable rows (columns vec_id and vector).  The pivots are a bounded sample, the ids
    with the smallest hashes; every row is indexed.  Queries go to the tasks in blocks of about ``block``; a
    task posts its vectors under their ``listed`` nearest pivots, ranks them by footrule distance, and measures the true
    distance of the first ``share``.  A task keeps k rows a query, so what is shuffled does not grow with the rows.

    Null, zero and broken vectors take no part, a query's own id is no answer, equal distances go to the smaller id, and a
    row that repeats an id is a candidate of its own.  With too few rows all are returned.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    schema = "query_id long, vec_id long, score double"
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    wanted = rows.filter(queries).distinct()
    total = wanted.count()
    parts = []
    blocks = -(-total // block)
    for b in range(blocks):
        one = wanted if blocks == 1 else wanted.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        found = sorted((r["vec_id"], r["vector"]) for r in one.collect())
        if not found:
            continue
        shared = spark.sparkContext.broadcast((np.array([r["vector"] for r in sample]), np.array([i for i, _ in found], np.int64),
                                               np.array([v for _, v in found])))
        dim = len(found[0][1])
        parts.append(rows.mapInArrow(_search(shared, k, min(listed, len(sample)), share, fewest, dim), schema))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
