"""Approximate nearest neighbours through a kept index of cells with stored one-bit codes.

Vectors lie under the nearest of the cells' centres and, to soften borders, under a few more. A search reads the cells nearest
to its queries. With ``rerank`` it reads the codes alone first, some bits instead of floats per dimension, and then the vectors
of the best candidates. An index is kept up with a table's changes: new vectors are assigned, cells that have grown too large
are split in two and those that have become too small are given up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import as_matrix, matrix
from ..plans.chunks import checkpointed
from ..plans.skew import counted_join, fits, lookup
from .knn import FOUND, Best, ranked, small_block, usable_queries

#: Largest sample that centres are fitted on; members that a cell is made for; most cells, which are in the driver's memory.
SAMPLE, CELL_ROWS, MOST_CELLS = 65_536, 1_000, 8_192
#: A cell is split above so many times, and given up below so many times, ``CELL_ROWS``.
SPLIT, MERGE = 2.0, 0.1
#: Vectors of a cell that its two halves are fitted on, and rows of a cell that meet its queries in one task.
HALVES, CELL_BLOCK = 2_048, 65_536


def unit(x: np.ndarray, space: str) -> np.ndarray:
    """Rows scaled to length 1 under cosine, else as they are."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-32) if space == "cosine" else x


def kmeans(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 3, balance: float = 0.0) -> np.ndarray:
    """Centres of ``cells`` cells by Lloyd's iterations; ``balance`` adds that share of the mean distance per surplus share of
    members, so that crowded cells shrink."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    load = np.ones(len(c))
    for _ in range(rounds):
        d = matrix(x, c, "l2")
        own = (d + balance * d.mean() * (load - 1)[None]).argmin(1)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        load = n / max(1.0, n.mean())
    return c


def nearest_cells(x: np.ndarray, centres: np.ndarray, between: np.ndarray, replicas: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, cells): each vector's nearest cell and up to ``replicas`` in all; a further one only if its distance is at most
    ``1 + epsilon`` times that of the nearest and no cell taken before is nearer to it than the vector is."""
    d = matrix(x, centres, "l2")
    order = np.argsort(d, axis=1, kind="stable")[:, : replicas * 4]
    near = np.take_along_axis(d, order, 1)
    taken = np.full((len(x), replicas), -1)
    held = np.zeros(len(x), np.int64)
    for t in range(order.shape[1]):
        j, ok = order[:, t], (held < replicas) & (near[:, t] <= (1 + epsilon) * near[:, 0])
        for s in range(replicas):
            ok &= (held <= s) | (between[j, taken[:, s]] >= near[:, t])
        at = np.flatnonzero(ok | (t == 0))
        taken[at, held[at]] = j[at]
        held[at] += 1
    rows, slot = np.nonzero(taken >= 0)
    return rows, taken[rows, slot]


def encode(x: np.ndarray, centres: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of vectors in their cells: the signs of the residual as bits, and (length, how well the signs stand for the
    residual, its inner product with the centre)."""
    c = centres[cell]
    r = x - c
    norm = np.linalg.norm(r, axis=1)
    fit = np.abs(r).sum(1) / np.sqrt(x.shape[1]) / np.maximum(norm, 1e-32)
    return np.packbits(r >= 0, axis=1), np.stack([norm, np.maximum(fit, 1e-6), (r * c).sum(1)], axis=1)


def estimate(q: np.ndarray, bits: np.ndarray, parts: np.ndarray, centre: np.ndarray, space: str) -> np.ndarray:
    """Matrix of the distances of queries from coded vectors of one cell, as their codes tell them."""
    p = q - centre
    signs = (np.unpackbits(bits, axis=1, count=q.shape[1]).astype(np.float32) * 2 - 1) / np.sqrt(q.shape[1])
    inner = (p.astype(np.float32) @ signs.T).astype(float) * (parts[:, 0] / parts[:, 1])[None]
    if space == "l2":
        return (parts[:, 0] ** 2)[None] + (p * p).sum(1)[:, None] - 2 * inner
    return 1.0 - (inner + parts[:, 2][None] + (q @ centre)[:, None])


@dataclass
class CellIndex:
    """Vectors by cell: ``rows`` has id, vector, cell, code and parts (see ``encode``); a vector may be in several cells."""

    rows: DataFrame
    centres: np.ndarray
    space: str
    replicas: int = 2
    epsilon: float = 0.3

    def write(self, path: str) -> CellIndex:
        """Save, partitioned by cell, so that a search reads the probed cells only; gives the saved index."""
        spark = self.rows.sparkSession
        self.rows.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        centres = [(n, c.tolist(), self.space, self.replicas, self.epsilon) for n, c in enumerate(self.centres)]
        spark.createDataFrame(centres, "cell int, centre array<double>, space string, replicas int, epsilon double").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        return CellIndex.read(spark, path)

    @staticmethod
    def read(spark, path: str) -> CellIndex:
        c = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
        schema = "id long, vector array<float>, code binary, parts array<double>, cell int"
        return CellIndex(spark.read.schema(schema).parquet(f"{path}/rows"), np.array([r["centre"] for r in c]), c[0]["space"], c[0]["replicas"], c[0]["epsilon"])

    def assigned(self, vectors: DataFrame) -> DataFrame:
        """Index rows of (id, vector); vectors that are null, hold nulls or have another length are left out."""
        c, space, replicas, epsilon = self.centres, self.space, self.replicas, self.epsilon
        between = matrix(c, c, "l2")

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, m = as_matrix(b.column(1), c.shape[1])
                m = unit(m, space)
                rows, cell = nearest_cells(m, c, between, replicas, epsilon)
                bits, parts = encode(m[rows], c, cell)
                pick = pa.array(at[rows], pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * len(rows) + 1, 3), pa.int32()), pa.array(parts.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pick), b.column(1).take(pick), pa.array([x.tobytes() for x in bits], pa.binary()), lists, pa.array(cell, pa.int32())], ["id", "vector", "code", "parts", "cell"])

        slim = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector")).filter("id is not null and vector is not null")
        return slim.mapInArrow(assign, "id long, vector array<float>, code binary, parts array<double>, cell int")

    def changed(self, gone: DataFrame, new: DataFrame) -> CellIndex:
        """The index without the ids of ``gone`` and with the vectors of ``new`` (id, vector)."""
        out = gone.select(F.col("id").cast("long").alias("_gone")).distinct()
        kept = self.rows.join(F.broadcast(out) if fits(out) else out, F.col("id") == F.col("_gone"), "left_anti")
        return CellIndex(kept.unionByName(self.assigned(new)), self.centres, self.space, self.replicas, self.epsilon)

    def maintained(self, cell_rows: int = CELL_ROWS) -> CellIndex:
        """One round of upkeep: cells above ``SPLIT * cell_rows`` rows are split by 2-means, those below ``MERGE * cell_rows``
        are given up, and the vectors of both go to the cells that are now nearest. Other cells keep their rows as they are."""
        rows = checkpointed(self.rows)
        sizes = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MOST_CELLS
        large = sorted((j for j, n in sizes.items() if n > SPLIT * cell_rows), key=lambda j: -sizes[j])[: max(0, MOST_CELLS - len(self.centres))]
        small = [j for j in range(len(self.centres)) if sizes.get(j, 0) < MERGE * cell_rows]
        small = small if len(small) < len(self.centres) else small[1:]
        if not large and not small:
            return CellIndex(rows, self.centres, self.space, self.replicas, self.epsilon)
        space = self.space
        share = F.element_at(F.create_map(*[F.lit(x) for j in large for x in (j, min(1.0, 2.0 * HALVES / sizes[j]))]), F.col("cell")) if large else F.lit(0.0)

        def halves(key: tuple, t: pa.Table) -> pa.Table:
            x = unit(as_matrix(t["vector"], len(t["vector"][0]))[1], space)
            return pa.table({"cell": pa.array([key[0].as_py()] * 2, pa.int32()), "centre": pa.array([c.tolist() for c in _two(x)], pa.list_(pa.float64()))})

        new: list[np.ndarray] = []
        if large:
            drawn = rows.filter(F.col("cell").isin(*large) & (F.pmod(F.xxhash64(F.lit(13), "id"), F.lit(1 << 30)) < share * (1 << 30)))
            got = drawn.groupBy("cell").applyInArrow(halves, "cell int, centre array<double>").collect()  # two rows a split cell
            new = [np.array(r["centre"]) for r in sorted(got, key=lambda r: (r["cell"], r["centre"]))]
        moved = sorted({*large, *small})
        stay = [j for j in range(len(self.centres)) if j not in set(moved)]
        after = CellIndex(rows, np.array([*self.centres[stay], *new]), space, self.replicas, self.epsilon)
        number = F.create_map(*[F.lit(x) for pair in ((j, n) for n, j in enumerate(stay)) for x in pair]) if stay else None
        still = rows.filter(~F.col("cell").isin(*moved))
        still = still.withColumn("cell", F.element_at(number, F.col("cell"))) if stay else still.limit(0)
        # A vector in a cell that goes is assigned anew as a whole, so its copies in cells that stay are taken out first.
        ids = checkpointed(rows.filter(F.col("cell").isin(*moved)).select("id", "vector").dropDuplicates(["id"]))
        out = ids.select(F.col("id").alias("_gone"))
        still = still.join(F.broadcast(out) if fits(out) else out, F.col("id") == F.col("_gone"), "left_anti")
        after.rows = still.unionByName(after.assigned(ids)).select("id", "vector", "code", "parts", "cell")
        return after


def _two(x: np.ndarray) -> np.ndarray:
    """Two centres of the rows; for equal rows, the row and one a hair beside it."""
    c = kmeans(x, 2, seed=1)
    return c if len(c) == 2 and (c[0] != c[1]).any() else np.stack([x[0], x[0] + 1e-6])


def build_cells(corpus: DataFrame, cells: int | None = None, space: str = "l2", replicas: int = 2, epsilon: float = 0.3, id: str = "id", vector: str = "embedding", sample: int = SAMPLE) -> CellIndex:
    """Index of every usable vector of ``corpus`` (see ``nearest_cells``), by default with a cell per ``CELL_ROWS`` vectors.

    Centres are fitted on at most ``sample`` vectors, at least 32 a cell; more cells come by splits (``maintained``).
    """
    slim = corpus.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector")).filter("id is not null and vector is not null")
    total = slim.count()
    cells = min(max(1, round(total / CELL_ROWS)), sample // 32) if cells is None else cells
    drawn = slim.filter(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, 2.0 * sample / max(1, total))) + 1).orderBy(F.xxhash64(F.lit(11), "id")).limit(sample).select("vector").toArrow()
    if not len(drawn):
        raise ValueError("no vectors to index")
    centres = kmeans(unit(as_matrix(drawn["vector"], len(drawn["vector"][0]))[1], space), cells)
    index = CellIndex(slim, centres, space, replicas, epsilon)
    index.rows = index.assigned(slim)
    return index


def _codes(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -(-dim // 8))


def search_cells(index: CellIndex, queries: DataFrame, k: int = 10, probes: int = 8, query_id: str = "query_id", query: str = "query", rerank: int | None = None) -> DataFrame:
    """As ``knn``, over the ``probes`` nearest cells of each query only.

    With ``rerank``, the codes estimate the distances, and of the ``rerank`` rows with the smallest estimates per query, over
    all its cells, the exact distances are taken; a result depends neither on partitions nor on batches. A query set of one
    block goes to the cells' rows, of which no others are read; of a larger one the queries meet the rows cell by cell.
    """
    space, c = index.space, index.centres
    asked = usable_queries(queries, query_id, query)
    most = k if rerank is None else max(k, rerank)
    cols = ["id", "cell", "vector"] if rerank is None else ["id", "cell", "code", "parts"]

    def probed(q: np.ndarray) -> np.ndarray:
        return np.argsort(matrix(unit(q, space), c, "l2"), axis=1, kind="stable")[:, :probes]

    def scan(best: Best, q: np.ndarray, cells: dict[int, np.ndarray], rows: pa.Table | pa.RecordBatch) -> None:
        """Add the rows to the best of the queries that probe their cells."""
        own, cell = (np.asarray(rows.column(n).to_numpy()) if isinstance(rows, pa.Table) else rows.column(n).to_numpy(zero_copy_only=False) for n in (0, 1))
        if rerank is None:
            at, m = as_matrix(rows.column(2), q.shape[1])
            own, cell = own[at], cell[at]
        else:
            bits, parts = _codes(rows.column(2), q.shape[1]), as_matrix(rows.column(3), 3)[1]
        for j in np.unique(cell):
            who = cells.get(int(j), np.empty(0, np.int64))
            if not len(who):
                continue
            at = np.flatnonzero(cell == j)
            if rerank is None:
                best.add_block(matrix(q[who], m[at], space), own[at], who)
            else:
                best.add_block(estimate(unit(q[who], space), bits[at], parts[at], c[j], space), own[at], who)

    small = small_block(asked)
    if small is not None:
        names, q = small
        if not len(names):
            return index.rows.sparkSession.createDataFrame([], f"{FOUND}, rank long")
        near = probed(q)
        cells = {int(j): np.flatnonzero((near == j).any(1)) for j in np.unique(near)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(names), most)
            for b in batches:
                scan(best, q, cells, b)
            yield best.batch(names)

        found = index.rows.filter(F.col("cell").isin(*cells)).select(*cols).mapInArrow(run, FOUND)
    else:

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, q = as_matrix(b.column(1), c.shape[1])
                near = probed(q)
                pick = pa.array(np.repeat(at, near.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pick), b.column(1).take(pick), pa.array(near.ravel(), pa.int32())], ["i", "v", "_cell"])

        # Cells of any size: the rows of a long one are cut into blocks that all its queries visit.
        sizes = checkpointed(index.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select(F.col("cell").alias("_cell"), F.ceil(F.col("n") / CELL_BLOCK).cast("int").alias("_blocks")))
        rows = lookup(index.rows.select(*cols).withColumn("_cell", F.col("cell")), sizes, ["_cell"], "inner", salt=F.col("id")).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
        visits = lookup(asked.mapInArrow(spread, f"i long, v {asked.schema['v'].dataType.simpleString()}, _cell int"), sizes, ["_cell"], "inner", salt=F.col("i"))
        visits = visits.withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            names = a["i"].to_numpy()
            out = []
            for s in range(0, len(a) if len(b) else 0, 1024):
                part = a.slice(s, 1024)
                q, best = as_matrix(part["v"], c.shape[1])[1], Best(len(part), most)
                everyone = {int(j): np.arange(len(part)) for j in np.unique(b["cell"].to_numpy())}
                for batch in b.select(cols).combine_chunks().to_batches(max_chunksize=2048):
                    scan(best, q, everyone, batch)
                out.append(best.batch(names[s : s + 1024]))
            return pa.Table.from_batches(out or [Best(0, most).batch(names[:0])])

        found = visits.select("i", "v", "_cell", "_b").groupBy("_cell", "_b").cogroup(rows.select(*cols, "_cell", "_b").groupBy("_cell", "_b")).applyInArrow(meet, FOUND)
    if rerank is None:
        return ranked(found, k)
    return ranked(_measured(index, asked, ranked(found, most)), k)


def _measured(index: CellIndex, asked: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with their exact distances: the vectors of these rows alone are joined."""
    space = index.space
    picked = checkpointed(candidates.select("query_id", "id"))
    wanted = checkpointed(picked.groupBy("id").agg(F.count(F.lit(1)).alias("_n")))
    slim = index.rows.select("id", "vector")
    narrow = slim.join(F.broadcast(wanted.select("id")), "id", "left_semi") if fits(wanted) else slim.join(wanted.select("id"), "id", "left_semi")
    vectors = checkpointed(narrow.dropDuplicates(["id"]).join(wanted, "id"))
    pairs = counted_join(picked, vectors, ["id"], "_n", F.col("query_id"))
    pairs = lookup(pairs, asked.select(F.col("i").alias("query_id"), F.col("v").alias("_q")), ["query_id"], "inner", salt=F.col("id"), most=4096)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, x = (as_matrix(b.column(n), len(b.column(n)[0]))[1] if b.num_rows else np.zeros((0, 1)) for n in (2, 3))
            d = ((x - q) ** 2).sum(1) if space == "l2" else 1.0 - (unit(x, space) * unit(q, space)).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d, pa.float64())], ["query_id", "id", "distance"])

    return pairs.select("query_id", "id", "_q", "vector").mapInArrow(measure, FOUND)
