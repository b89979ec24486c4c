"""Sparse retrieval: BM25 weights, inverse document frequencies and nearest sparse vectors.

Sparse vectors are rows (id, dim, weight): an inverted index is this table, clustered by ``dim`` if it is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.chunks import checkpointed
from ..plans.skew import fits, lookup

K1, B, MEAN_LENGTH = 1.2, 0.75, 256.0
#: Most queries that meet the postings in one pass.
QUERY_BLOCK = 32768
#: Records whose scores for all queries of a block are in memory at once, at most, and their scores.
RECORD_BLOCK, SCORES = 256, 1 << 21
#: A dimension that more than this share of the queries ask for is multiplied densely, if no more than so many cells are.
DENSE_SHARE, DENSE_CELLS = 0.05, 1 << 24


def bm25_weights(docs: DataFrame, id: str, text: str, k: float = K1, b: float = B, mean_length: float = MEAN_LENGTH, stem: bool = True) -> DataFrame:
    """(id, dim, weight): the saturated term frequency of each token of each text; null texts have none.

    A text is one row, so its tokens are counted where they are, and nothing is shuffled. Each row is a record of its own.
    """
    toks = docs.select(F.col(id).alias("id"), T.tokens(F.col(text), stem).alias("_t")).filter("_t is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            length = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            terms = lists.flatten().dictionary_encode()
            if not len(terms):
                continue
            width = len(terms.dictionary)
            cells, tf = np.unique(np.repeat(np.arange(len(length)), length) * width + terms.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row = cells // width
            weight = tf * (k + 1) / (tf + k * (1 - b + b * length[row] / mean_length))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), terms.dictionary.take(pa.array(cells % width)), pa.array(weight)], ["id", "dim", "weight"])

    return toks.mapInArrow(count, f"id {toks.schema['id'].dataType.simpleString()}, dim string, weight double")


def idf(postings: DataFrame, size: int | Column) -> DataFrame:
    """(dim, idf): rarity of each dimension among ``size`` records of the whole collection, filtered or not."""
    n = F.lit(size) if isinstance(size, int) else size
    df = postings.groupBy("dim").agg(F.count(F.lit(1)).alias("_df"))
    held = F.least(F.col("_df"), n)
    return df.select("dim", F.col("_df").alias("df"), F.log1p((n - held + 0.5) / (held + 0.5)).alias("idf"))


def rescale(queries: DataFrame, rarity: DataFrame, size: int) -> DataFrame:
    """Query rows (query_id, dim, weight) with their weights times the dimension's idf; a dimension that no record has counts
    as held by none."""
    q = lookup(queries, rarity.select("dim", "idf"), ["dim"], "left", salt=F.col("query_id"))
    return q.select("query_id", "dim", (F.col("weight") * F.coalesce("idf", F.log1p(F.lit((size + 0.5) / 0.5)))).alias("weight"))


def sparse_knn(postings: DataFrame, queries: DataFrame, k: int = 10, all_ids: DataFrame | None = None) -> DataFrame:
    """(query_id, id, distance, rank): the ``k`` records with the smallest ``1 - inner product`` for each query.

    Only records that share a dimension with the query take part; with ``all_ids`` (the index-free form) every one of these
    does once, and no other, at distance 1 without a common dimension. Ties go to the smaller id. The postings are brought
    together by record and a partition hands on only its ``k`` best per query, as in ``knn``.
    """
    return _ranked(_best(postings, queries, k, all_ids), k)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def _best(postings: DataFrame, queries: DataFrame, k: int, all_ids: DataFrame | None) -> DataFrame:
    """(query_id, id, distance): the ``k`` best of each partition of the records for each query.

    The queries are gathered, ``QUERY_BLOCK`` at a time at most; each block is one pass over the records, which are shuffled
    once. With ``all_ids`` a query without a dimension is one too.
    """
    q = queries.groupBy("query_id", "dim").agg(F.sum("weight").alias("_q"))
    slim = postings.select("id", "dim", "weight").filter("weight is not null")
    if all_ids is None:
        q = q.filter("query_id is not null and dim is not null and _q is not null")
    else:
        own = all_ids.select(F.col(all_ids.columns[0]).alias("id"))
        # As in a join, a null is not equal to a null.
        slim = slim.filter("id is not null").withColumn("id", F.col("id").cast(own.schema["id"].dataType))
    ids = q.select("query_id").distinct()
    blocks = 1 if fits(ids, QUERY_BLOCK) else int(np.ceil(ids.count() / (QUERY_BLOCK / 2)))
    if blocks > 1:
        q = checkpointed(q)
    kinds = f"query_id {q.schema['query_id'].dataType.simpleString()}, id {slim.schema['id'].dataType.simpleString()}, distance double"
    parts, placed, dims = [], None, None
    for n in range(blocks):
        t = (q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n)).toArrow()
        if not len(t):
            continue
        if placed is None:
            asked = (t if blocks == 1 else q.select("dim").distinct().toArrow())["dim"].combine_chunks()
            dims = asked.drop_null().unique()
            at = q.sparkSession.createDataFrame(pa.table({"dim": dims, "_j": pa.array(np.arange(len(dims), dtype=np.int32))}), f"dim {q.schema['dim'].dataType.simpleString()}, _j int")
            at = at.withColumn("dim", F.col("dim").cast(slim.schema["dim"].dataType))
            met = lookup(slim, at, ["dim"], "inner", salt=F.col("id")).select("id", "_j", F.col("weight").cast("double").alias("weight"))
            if all_ids is not None:
                met = met.unionByName(own.select("id", F.lit(-1).alias("_j"), F.lit(0.0).alias("weight")))
            # Records come in the order of their ids, so that of equal distances the earlier one is the one with the smaller id.
            packed = met.mapInArrow(_packed, f"id {slim.schema['id'].dataType.simpleString()}, _j binary, _w binary")
            placed = packed.repartition("id").sortWithinPartitions("id")
        who = t["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        use = pc.and_(pc.and_(pc.is_valid(t["query_id"]), pc.is_valid(t["dim"])), pc.is_valid(t["_q"])).to_numpy()
        row, weight = (x.to_numpy(zero_copy_only=False)[use] for x in (who.indices, t["_q"].combine_chunks()))
        dim = pc.index_in(t["dim"].combine_chunks(), dims).to_numpy(zero_copy_only=False)[use].astype(np.int64)
        order = np.lexsort((row, dim))
        start = np.searchsorted(dim[order], np.arange(len(dims) + 1))
        parts.append(placed.mapInArrow(_best_of_records(who.dictionary, start, row[order], weight[order].astype(float), k, all_ids is not None), kinds))
    if not parts:
        return q.sparkSession.createDataFrame([], kinds)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function over (id, dimension's number, weight): a row for the neighbouring ones of one id."""
    for batch in batches:
        if not batch.num_rows:
            continue
        id = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.diff(id, prepend=-1))
        ends = np.append(first, len(id))
        j, w = (np.ascontiguousarray(batch.column(c).to_numpy(zero_copy_only=False), t) for c, t in ((1, np.int32), (2, np.float64)))
        bytes_of = lambda x: pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first)), bytes_of(j), bytes_of(w)], ["id", "_j", "_w"])


def _best_of_records(who: pa.Array, start: np.ndarray, row: np.ndarray, weight: np.ndarray, k: int, everyone: bool):
    """mapInArrow function over (id, dimensions' numbers, weights), ordered by id: the ``k`` best records for each query.

    Dimension ``j`` is asked for by the queries ``row[start[j]:start[j + 1]]``, with the weights there. With ``everyone`` the
    records that have a number -1 take part, and all of these.
    """
    size, count = len(who), np.diff(start)
    positive = bool((weight > 0).all())
    most = max(1, min(RECORD_BLOCK, SCORES // max(1, size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The densely multiplied dimensions, as rows of a matrix; -1 for the others.
        hot = np.flatnonzero(count > max(8, DENSE_SHARE * size))
        hot = hot[np.argsort(-count[hot], kind="stable")][: max(1, DENSE_CELLS // max(1, size))]
        place = np.full(len(count), -1)
        place[hot] = np.arange(len(hot))
        dense = np.zeros((len(hot), size))
        asks = None if positive or everyone else np.zeros((len(hot), size))
        for n, j in enumerate(hot):
            dense[n, row[start[j] : start[j + 1]]] = weight[start[j] : start[j + 1]]
            if asks is not None:
                asks[n, row[start[j] : start[j + 1]]] = 1.0
        own: list[pa.Array] = []
        seen = 0
        # Query, position of the record, distance: at most k of each query, kept sorted by query.
        bq, bp, bd = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        # The same of those that have not yet been sorted in, and how many they are.
        wait: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0
        # What a score must exceed: a later record of the same rounded distance has a larger id.
        least = np.full(size, -np.inf)

        def block(rec: np.ndarray, j: np.ndarray, w: np.ndarray, records: int) -> None:
            nonlocal waiting
            there = None
            if everyone:
                there = np.zeros(records, bool)
                there[rec[j < 0]] = True
                used = (j >= 0) & there[rec]
                rec, j, w = rec[used], j[used], w[used]
            mask = there is None and positive and bool((w > 0).all())
            met = None if mask or everyone else np.zeros((records, size), bool)
            at = place[j]
            d = at >= 0
            if d.any():
                m = np.zeros((records, len(hot)))
                np.add.at(m, (rec[d], at[d]), w[d])
                s = m @ dense
                if met is not None:
                    h = np.zeros((records, len(hot)))
                    h[rec[d], at[d]] = 1.0
                    met |= h @ (dense != 0 if asks is None else asks) > 0
            else:
                s = np.zeros((records, size))
            for r, x, v in zip(rec[~d].tolist(), j[~d].tolist(), w[~d].tolist()):
                a, b = start[x], start[x + 1]
                s[r][row[a:b]] += v * weight[a:b]
                if met is not None:
                    met[r][row[a:b]] = True
            good = s > (np.maximum(least, 0.0) if mask else least)
            if not mask:
                good &= there[:, None] if met is None else met
            p, x = np.divmod(np.flatnonzero(good), size)
            wait.append((x, p + seen, 1.0 - s[p, x]))
            waiting += len(p)
            if waiting > max(1 << 14, size * k // 2):
                merge()

        def merge() -> None:
            nonlocal bq, bp, bd, least, waiting
            bq, bp, bd = (np.concatenate(x) for x in zip((bq, bp, bd), *wait))
            wait.clear()
            waiting = 0
            o = np.lexsort((bp, np.round(bd, 9), bq))
            bq, bp, bd = bq[o], bp[o], bd[o]
            first = np.searchsorted(bq, np.arange(size))
            keep = np.arange(len(bq)) - first[bq] < k
            bq, bp, bd = bq[keep], bp[keep], bd[keep]
            have = np.bincount(bq, minlength=size)
            last = np.cumsum(have) - 1
            full = have == k
            kth = np.round(bd[np.maximum(last, 0)], 9) if len(bd) else np.zeros(size)
            least = np.where(full, 1.0 - kth + 4e-10 - 1e-14 * np.abs(kth), -np.inf)

        def done(t: pa.Table, everything: bool) -> pa.Table:
            """Work off the records that are whole, all or all but the last one; the rest is given back."""
            nonlocal seen
            id = t["id"].combine_chunks().dictionary_encode(null_encoding="encode")
            packs = id.indices.to_numpy(zero_copy_only=False)
            whole = len(id.dictionary) - (0 if everything else 1)
            upto = int(np.searchsorted(packs, whole))
            j, w = (np.frombuffer(b"".join(t[c].slice(0, upto).to_pylist()), kind) for c, kind in (("_j", np.int32), ("_w", np.float64)))
            rec = np.repeat(packs[:upto], pc.binary_length(t["_j"]).to_numpy()[:upto] // 4)
            a = 0
            while a < whole:
                # Few records at first, as nearly all of these are among the best so far.
                b = min(whole, a + min(most, max(16, seen)))
                x, y = np.searchsorted(rec, (a, b))
                block(rec[x:y] - a, j[x:y], w[x:y], b - a)
                own.append(id.dictionary.slice(a, b - a))
                seen += b - a
                a = b
            return t.slice(upto)

        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows > RECORD_BLOCK * 4:
                held = done(pa.Table.from_batches(held), False).to_batches()
                rows = 0
        if held:
            done(pa.Table.from_batches(held), True)
            merge()
        if seen and len(bq):
            ids = pa.concat_arrays(own)
            yield pa.RecordBatch.from_arrays([who.take(pa.array(bq)), ids.take(pa.array(bp)), pa.array(bd)], ["query_id", "id", "distance"])

    return run
