"""Exact nearest neighbours of stated query vectors.

A partition of the corpus computes its distances block-wise in NumPy and hands on only its ``k`` best per query, so what is
shuffled is partitions * queries * k rows, not the product of queries and corpus. A query set that is too large for one block
never passes through the driver: blocks of queries and blocks of the corpus meet in a cogroup.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import SPACES, as_matrix, matrix
from ..plans.skew import fits

#: Most query vectors that are broadcast; of more, and of the corpus then, the rows of a block.
QUERY_BLOCK, CORPUS_BLOCK = 4096, 131_072
#: Rows of the corpus whose distances from all queries of a block are in memory at once.
ROW_BLOCK = 2048
FOUND = "query_id long, id long, distance double"


class Best:
    """The ``k`` smallest (distance, id) of each query among what was added, every id once."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.q, self.i, self.d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.bound = np.full(queries, np.inf)

    def add(self, q: np.ndarray, i: np.ndarray, d: np.ndarray) -> None:
        q, i, d = np.concatenate([self.q, q]), np.concatenate([self.i, i]), np.concatenate([self.d, d])
        r = np.round(d, 9)
        o = np.lexsort((r, i, q))
        o = o[np.r_[True, (np.diff(q[o]) != 0) | (np.diff(i[o]) != 0)]] if len(o) else o
        o = o[np.lexsort((i[o], r[o], q[o]))]
        q, i, d = q[o], i[o], d[o]
        keep = np.arange(len(q)) - np.searchsorted(q, np.arange(len(self.bound)))[q] < self.k
        self.q, self.i, self.d = q[keep], i[keep], d[keep]
        n = np.bincount(self.q, minlength=len(self.bound))
        last = np.cumsum(n) - 1
        full = n == self.k
        self.bound[full] = self.d[last[full]]

    def add_block(self, d: np.ndarray, ids: np.ndarray, queries: np.ndarray | None = None) -> None:
        """All rows of a block: ``d`` (queries, rows), for all queries or those given; what cannot be among the best is left out."""
        queries = np.arange(len(d)) if queries is None else queries
        bound = self.bound[queries]
        if d.shape[1] > self.k:
            bound = np.minimum(bound, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
        q, x = np.nonzero(d <= (bound + 2e-9)[:, None])
        self.add(queries[q], ids[x], d[q, x])

    def batch(self, names: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names[self.q], pa.int64()), pa.array(self.i, pa.int64()), pa.array(self.d, pa.float64())], ["query_id", "id", "distance"])


def usable_queries(queries: DataFrame, query_id: str, query: str) -> DataFrame:
    """(i, v) of the queries that take part; ValueError if their vectors differ in length."""
    q = queries.select(F.col(query_id).cast("long").alias("i"), F.col(query).alias("v")).filter("i is not null and v is not null")
    if q.select(F.size("v")).distinct().limit(2).count() > 1:
        raise ValueError("query vectors differ in length")
    return q


def small_block(q: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """(ids, matrix) of a query set of at most ``QUERY_BLOCK`` rows, else None."""
    if not fits(q, QUERY_BLOCK):
        return None
    t = q.toArrow()
    return t["i"].to_numpy(), as_matrix(t["v"], len(t["v"][0]))[1] if len(t) else np.zeros((0, 0))


def _add_rows(best: Best, ids: pa.Array, vectors: pa.Array, q: np.ndarray, space: str) -> None:
    at, m = as_matrix(vectors, q.shape[1])
    own = ids.take(pa.array(at, pa.int64())).to_numpy(zero_copy_only=False)
    for s in range(0, len(m), ROW_BLOCK):
        best.add_block(matrix(q, m[s : s + ROW_BLOCK], space), own[s : s + ROW_BLOCK])


def ranked(candidates: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest candidates (query_id, id, distance) of each query, once each, with ``rank`` from 1; ties by id."""
    once = candidates.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    return once.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def knn(corpus: DataFrame, queries: DataFrame, k: int = 10, space: str = "l2", id: str = "id", vector: str = "embedding", query_id: str = "query_id", query: str = "query") -> DataFrame:
    """(query_id, id, distance, rank): exact ``k`` nearest rows of ``corpus`` for each query; ids are longs.

    Null vectors, vectors with nulls and vectors of another length than the query's take no part. Ties go to the smaller
    id. An empty corpus or query set gives an empty result. ``k`` must be positive.
    """
    if k < 1:
        raise ValueError("k must be positive")
    if space not in SPACES:
        raise ValueError(f"unknown space {space!r}")
    slim = corpus.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v")).filter("id is not null and v is not null")
    asked = usable_queries(queries, query_id, query)
    small = small_block(asked)
    if small is None:
        return ranked(_in_blocks(slim, asked, k, space), k)
    names, q = small

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(names), k)
        for b in batches:
            _add_rows(best, b.column(0), b.column(1), q, space)
        yield best.batch(names)

    return ranked(slim.mapInArrow(run, FOUND), k)


def _in_blocks(slim: DataFrame, asked: DataFrame, k: int, space: str) -> DataFrame:
    """Candidates of large query sets: every block of queries meets every block of the corpus."""
    nq, nc = int(np.ceil(asked.count() / QUERY_BLOCK)), max(1, int(np.ceil(slim.count() / CORPUS_BLOCK)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("i", "v", F.pmod(F.xxhash64("i"), F.lit(nq)).cast("int").alias("_q")).withColumn("_c", every(nc))
    right = slim.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(nc)).cast("int").alias("_c")).withColumn("_q", every(nq))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        names = a["i"].to_numpy()
        best = Best(len(names), k)
        if len(a) and len(b):
            _add_rows(best, b["id"].combine_chunks(), b["v"].combine_chunks(), as_matrix(a["v"], len(a["v"][0]))[1], space)
        return pa.Table.from_batches([best.batch(names)])

    return left.groupBy("_q", "_c").cogroup(right.groupBy("_q", "_c")).applyInArrow(meet, FOUND)


def merge(lists: list[DataFrame], k: int) -> DataFrame:
    """One ranking of several results of ``knn`` (shards, log and segment): the ``k`` nearest, every id once."""
    found = lists[0].select("query_id", "id", "distance")
    for x in lists[1:]:
        found = found.unionByName(x.select("query_id", "id", "distance"))
    return ranked(found, k)
