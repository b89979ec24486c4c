"""Nearest neighbours of every vector of its collection by a permutation index of two levels.

Each collection gets pivots: a bounded sample of its vectors, some of which are moved to the mean of the sampled vectors
nearest to them. A vector is posted in the inverted files of the first ``POSTS`` pivots of its order of pivots. Within a file
a vector is represented by its order of the file's own pivots, drawn from its members; the footrule distance of these whole
orders chooses the candidates, and only these are ranked again by the exact distance. The footrule is taken over positions
in classes, as the Hamming distance of thermometer codes.

With squared distances, pivots of small length come first in nearly every order, and their files swallow the collection. So
pivots are ordered by the squared distance less half of the pivot's squared length, which keeps files short.

Every vector is posted and queried. A file longer than ``BLOCK`` is done whole, as pairs of blocks. Equal vectors are one
entry that carries their first ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.chunks import checkpointed
from ..plans.skew import counted_join, lookup
from .topn import top_n

#: Pivots of a collection per root of its size, and bounds of their number.
PIVOTS_PER_ROOT, LEAST_PIVOTS, MOST_PIVOTS = 1.5, 32, 16_384
#: Sampled vectors per pivot, and rounds of moving the pivots.
SAMPLE_PER_PIVOT, ROUNDS = 16, 3
POSTS, BLOCK = 5, 16_384
#: Pivots of a file, and the shares of them that bound the classes of positions.
FILE_PIVOTS, CLASSES = 96, (0.04, 0.12, 0.28, 0.55)
#: Candidates of a vector in a file (or block of one) per root of the file's size.
RERANK_PER_ROOT = 8.0
#: Most bytes of pivots that are broadcast; beyond, vectors meet their collection's pivots in slices of so many vectors.
PIVOT_BYTES, SLICE = 64 << 20, 65_536


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def pivot_keys(x: np.ndarray, pivots: np.ndarray, space: str, balance: float = 0.5) -> np.ndarray:
    """Matrix that sorts the pivots of each vector, nearest first; under l2, without ``balance`` of the pivot's squared length."""
    if space == "l2":
        return (1.0 - balance) * (pivots * pivots).sum(1)[None] - 2.0 * (x @ pivots.T)
    return -(x @ pivots.T)


def moved(sample: np.ndarray, pivots: np.ndarray, space: str, rounds: int = ROUNDS) -> np.ndarray:
    """Pivots after some rounds of moving each to the mean of the sampled vectors nearest to it."""
    for _ in range(rounds):
        at = np.concatenate([pivot_keys(sample[s : s + 4096], pivots, "cosine" if space == "cosine" else "l2", 0.0).argmin(1) for s in range(0, len(sample), 4096)])
        held = np.bincount(at, minlength=len(pivots))
        total = np.zeros_like(pivots)
        np.add.at(total, at, sample)
        pivots = np.where(held[:, None] > 0, total / np.maximum(held, 1)[:, None], pivots).astype(np.float32)
    return pivots


def codes(x: np.ndarray, pivots: np.ndarray, space: str) -> np.ndarray:
    """Thermometer codes of the positions of all pivots in each vector's order, as rows of 64-bit words."""
    order = np.argsort(pivot_keys(x, pivots, space, 0.0), axis=1, kind="stable")
    place = np.empty(order.shape, np.int16)
    np.put_along_axis(place, order, np.arange(order.shape[1], dtype=np.int16)[None], axis=1)
    bits = np.concatenate([place < max(1, int(order.shape[1] * c)) for c in CLASSES], axis=1)
    return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1).view(np.uint64)


def footrule(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix of footrule distances of coded orders."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def exact(x: np.ndarray, y: np.ndarray, space: str) -> np.ndarray:
    """Distances in double precision, rounded to 6 decimals, of each row of ``x`` (n, dim) to its own rows of ``y`` (n, k, dim)."""
    x, y = x.astype(np.float64)[:, None], y.astype(np.float64)
    if space == "l2":
        return np.round(((x - y) ** 2).sum(2), 6)
    dot = (x * y).sum(2)
    if space == "cosine":
        dot = dot / np.maximum(np.sqrt((x * x).sum(2)) * np.sqrt((y * y).sum(2)), 1e-300)
    return np.round(1.0 - dot, 6)


def nearest_in_file(x: np.ndarray, y: np.ndarray | None, space: str, k: int, per_root: float = RERANK_PER_ROOT, seed: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of x, their k nearest rows of y, the distances), some rows at a time; without ``y`` among the rows of ``x``.

    The footrule of the orders of drawn pivots names the candidates; no distance of any other pair is computed.
    """
    own = y is None
    y = x if own else y
    n = len(y)
    if len(x) == 0 or n < 1 + own:
        return
    fx, fy = (unit(x), unit(y)) if space == "cosine" else (x, y)
    both = fx if own else np.concatenate([fx, fy])
    pivots = both[np.random.default_rng(seed).permutation(len(both))[:FILE_PIVOTS]]
    cx = codes(fx, pivots, space)
    cy = cx if own else codes(fy, pivots, space)
    square = (fy * fy).sum(1)
    most = min(n - own, k + int(np.ceil(per_root * n**0.5)))
    step = max(16, min(128, (1 << 21) // n))
    for s in range(0, len(x), step):
        rows = np.arange(s, min(s + step, len(x)))
        f = footrule(cx[rows], cy)
        if own:
            f[np.arange(len(rows)), rows] = np.iinfo(np.uint16).max
        at = np.argpartition(f, most - 1, axis=1)[:, :most] if most < n else np.broadcast_to(np.arange(n), f.shape)
        dot = np.matmul(fy[at], fx[rows][:, :, None])[..., 0]
        rough = square[at] - 2.0 * dot if space == "l2" else -dot
        keep = min(most, 2 * k)
        at = np.take_along_axis(at, np.argpartition(rough, keep - 1, axis=1)[:, :keep], 1)
        d = exact(x[rows], y[at], space)
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        yield rows, np.take_along_axis(at, best, 1), np.take_along_axis(d, best, 1)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length of a column of lists of floats, or of their bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), np.float32)
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(column), -1)
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


def _lists(kind: pa.DataType, sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def _post(table: pa.Table, pivots: dict[str, np.ndarray], posts: int) -> Iterator[pa.RecordBatch]:
    """Entries with the files that they are posted in, and for those with copies the distance of equal vectors."""
    names = np.array(table.column("collection").to_pylist(), object)
    for c in dict.fromkeys(names.tolist()):
        part = table.filter(pa.array(names == c)) if len(table) else table
        if c not in pivots or not len(part):
            continue
        x, p, space = _matrix(part.column("emb")), pivots[c], part.column("space")[0].as_py()
        n = min(posts, len(p))
        near = np.concatenate([np.argpartition(pivot_keys(unit(v) if space == "cosine" else v, p, space), n - 1, axis=1)[:, :n] for v in (x[s : s + 4096] for s in range(0, len(x), 4096))])
        same = np.round(1.0 - (x.astype(np.float64) ** 2).sum(1), 6) if space == "ip" else np.zeros(len(x))
        cols = {
            "collection": part.column("collection").combine_chunks(),
            "space": part.column("space").combine_chunks(),
            "id": part.column("id").combine_chunks(),
            "ids": part.column("ids").combine_chunks(),
            "_n": part.column("_n").combine_chunks(),
            "same": pa.array(same),
            "files": _lists(pa.int32(), np.full(len(x), n), near.ravel().astype(np.int32)),
            "vec": pa.array([v.tobytes() for v in x], pa.binary()),
        }
        yield from pa.table(cols).to_batches()


def posted_entries(entries: DataFrame, sizes: DataFrame, pivots: DataFrame, posts: int) -> DataFrame:
    """``entries`` with ``files``, the pivots of their collection that they are posted under, and ``vec``, the vector's bytes.

    The pivots are broadcast if they have at most ``PIVOT_BYTES``, else repeated for every slice of a collection.
    """
    schema = "collection string, space string, id long, ids array<long>, _n long, same double, files array<int>, vec binary"
    if (pivots.agg(F.sum(F.length("pivots"))).first()[0] or 0) <= PIVOT_BYTES:
        held = {r["collection"]: np.frombuffer(r["pivots"], np.float32).reshape(r["m"], -1) for r in pivots.toLocalIterator()}
        shared = entries.sparkSession.sparkContext.broadcast(held)

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from _post(pa.Table.from_batches([b]), shared.value, posts)

        return entries.mapInArrow(post, schema)
    sliced = lookup(entries, sizes.select("collection", F.ceil(F.col("_n") / SLICE).cast("int").alias("_slices")), ["collection"], "inner", salt=F.col("id"))
    sliced = sliced.withColumn("_slice", F.pmod(F.xxhash64("id"), F.col("_slices")).cast("int")).drop("_slices")
    wide = pivots.join(sizes.select(F.col("collection").alias("_c"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / SLICE).cast("int") - 1)).alias("_ps")), F.col("collection") == F.col("_c"))

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        held = {r["collection"]: np.frombuffer(r["pivots"], np.float32).reshape(r["m"], -1) for r in right.to_pylist()}
        batches = list(_post(left, held, posts))
        return pa.Table.from_batches(batches) if batches else _arrow(schema).empty_table()

    return sliced.groupBy("collection", "_slice").cogroup(wide.select("collection", "_ps", "pivots", "m").groupBy("collection", "_ps")).applyInArrow(meet, schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in ddl.split(", "))])


FOUND = "collection string, id long, d array<double>, b array<long>"


def _search_file(k: int, per_root: float) -> Callable[[tuple, pa.Table], pa.Table]:
    """The search of one file, or of two blocks of one, as a function of its key and rows."""

    def expanded(ids: np.ndarray, at: np.ndarray, d: np.ndarray, members: pa.Array, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sizes, distances and ids of lists of entries, those with copies replaced by their first ids."""
        if not copies[at].any():
            return np.full(len(at), at.shape[1]), d.ravel(), ids[at].ravel()
        of = [m.as_py() or [i] for m, i in zip(members, ids.tolist(), strict=True)]
        lists = [[(dist, b) for j, dist in zip(r, ds, strict=True) for b in of[j]] for r, ds in zip(at.tolist(), d.tolist(), strict=True)]
        flat = [x for row in lists for x in row]
        return np.array([len(row) for row in lists]), np.array([x[0] for x in flat], float), np.array([x[1] for x in flat], np.int64)

    def search(key: tuple, g: pa.Table) -> pa.Table:
        i, j = key[2].as_py(), key[3].as_py()
        collection, space = key[0].as_py(), g.column("space")[0].as_py()
        own = g.column("_own").to_numpy()
        sides = [g] if i == j else [g.filter(pa.array(own == i)), g.filter(pa.array(own == j))]
        x = [_matrix(s.column("vec")) for s in sides]
        parts = []
        for one, other in ((0, None),) if i == j else ((0, 1), (1, 0)):
            target = sides[one if other is None else other]
            mine, ids = sides[one].column("id").to_numpy(), target.column("id").to_numpy()
            members = target.column("ids").combine_chunks()
            copies = members.is_valid().to_numpy(zero_copy_only=False)
            for rows, at, d in nearest_in_file(x[one], None if other is None else x[other], space, k, per_root):
                sizes, dist, b = expanded(ids, at, d, members, copies)
                parts.append(pa.table({"collection": pa.array([collection] * len(rows), pa.string()), "id": pa.array(mine[rows]), "d": _lists(pa.float64(), sizes, dist), "b": _lists(pa.int64(), sizes, b)}))
        return pa.concat_tables(parts) if parts else _arrow(FOUND).empty_table()

    return search


def neighbour_lists(entries: DataFrame, sizes: DataFrame, k: int = 5, per_root: float = RERANK_PER_ROOT, posts: int = POSTS, block: int = BLOCK) -> DataFrame:
    """(collection, id, near, _n): for every entry the nearest ids found, array of (d, b) by (rounded distance, id).

    ``entries``: collection, space, id (unique), emb (array of float), ids (the first ids of an entry with copies, else null)
    and _n (their number, else null), with no equal vectors. ``sizes``: collection and its number of entries. Lists hold
    ``k`` ids; of entries with copies ``k + 1``, their own first ids among them.
    """
    m = F.least(F.col("_n"), F.lit(MOST_PIVOTS), F.greatest(F.lit(LEAST_PIVOTS), F.ceil(F.sqrt("_n") * PIVOTS_PER_ROOT))).cast("int")
    drawn = lookup(entries.select("collection", "space", "emb"), sizes.withColumn("_m", m).withColumnRenamed("_n", "_size"), ["collection"], "inner", salt=F.col("emb")).withColumn("_h", F.xxhash64(F.lit(5), F.col("emb")))
    drawn = drawn.filter(F.pmod("_h", F.lit(1 << 30)) / float(1 << 30) < F.col("_m") * SAMPLE_PER_PIVOT / F.col("_size"))

    def draw(key: tuple, g: pa.Table) -> pa.Table:
        g = g.sort_by("_h")
        sample, space, m = _matrix(g.column("emb")), g.column("space")[0].as_py(), g.column("_m")[0].as_py()
        sample = unit(sample).astype(np.float32) if space == "cosine" else sample
        pivots = moved(sample, sample[:m].copy(), space)
        return pa.table({"collection": pa.array([key[0].as_py()], pa.string()), "m": pa.array([len(pivots)], pa.int32()), "pivots": pa.array([pivots.astype(np.float32).tobytes()], pa.binary())})

    pivots = checkpointed(drawn.groupBy("collection").applyInArrow(draw, "collection string, m int, pivots binary"))
    placed = checkpointed(posted_entries(entries, sizes, pivots, posts))
    files = placed.select("collection", F.explode("files").alias("pivot")).groupBy("collection", "pivot").agg(F.count(F.lit(1)).alias("_len"))
    long = checkpointed(files.filter(F.col("_len") > block).select("collection", "pivot", F.ceil(F.col("_len") / block).cast("int").alias("_blocks")))
    posted = placed.select("collection", "space", "id", "ids", "vec", F.explode("files").alias("pivot"))
    # A block of a long file meets itself and every other one of its file: pair (i, j) with i <= j.
    meets = lookup(posted, long, ["collection", "pivot"], salt=F.col("id")).withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    meets = meets.withColumn("_own", F.pmod(F.xxhash64(F.lit(7), F.col("id")), F.col("_blocks")).cast("int"))
    meets = meets.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    meets = meets.select("collection", "pivot", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", "space", "id", "ids", "vec")
    found = meets.groupBy("collection", "pivot", "_i", "_j").applyInArrow(_search_file(k, per_root), FOUND)
    own = placed.filter("ids is not null").select("collection", "id", F.transform("ids", lambda _: F.col("same")).alias("d"), F.col("ids").alias("b"), "_n")
    lists = found.withColumn("_n", F.lit(None).cast("long")).unionByName(own).groupBy("collection", "id")
    near = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("d", "b")))))
    merged = lists.agg(near.alias("near"), F.max("_n").alias("_n"))
    return merged.select("collection", "id", F.slice("near", F.lit(1), F.when(F.col("_n").isNull(), F.lit(k)).otherwise(F.lit(k + 1))).alias("near"), "_n")


def usable(vectors: DataFrame, collections: DataFrame) -> DataFrame:
    """(collection, space, id, emb): vectors that take part: of a known collection and space, of its dimension, neither null
    nor all zero, without null, NaN or infinite members."""
    dims = collections.select(F.col("collection_id").alias("collection"), F.col("dim").alias("_dim"), F.lower("space_name").alias("space")).dropDuplicates(["collection"])
    v = vectors.select(F.col("collection_id").alias("collection"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<float>").alias("emb"))
    v = lookup(v.filter("emb is not null and id is not null"), dims, ["collection"], "inner", salt=F.col("id"))
    bad = F.exists("emb", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.filter((F.size("emb") == F.col("_dim")) & F.col("space").isin("l2", "cosine", "ip") & ~bad & F.exists("emb", lambda x: x != 0)).drop("_dim")


def nearest_pairs(vectors: DataFrame, collections: DataFrame, k: int = 5, per_root: float = RERANK_PER_ROOT, posts: int = POSTS, block: int = BLOCK) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b: pairs of one collection of which at least one is among the other's ``k`` nearest.

    Distances are rounded to 6 decimals, ties go to the smaller id, no vector is its own neighbour, repeated vectors take
    part with their own ids; a row that is repeated with its id counts once. Empty tables give an empty result. Collections
    with fewer vectors give what there is.
    """
    rows = usable(vectors, collections).withColumns({"h1": F.xxhash64("emb"), "h2": F.xxhash64(F.lit(1), F.col("emb"))})
    cls = ["collection", "h1", "h2"]
    classes = checkpointed(rows.groupBy(*cls).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("_n")))
    sizes = checkpointed(classes.groupBy("collection").agg(F.count(F.lit(1)).alias("_n")))

    # The members of every class of equal vectors, and its first ids. Most vectors have no copies and are left out here.
    many = checkpointed(classes.filter("_n > 1"))
    copies = checkpointed(lookup(rows.select(*cls, "id"), many, cls, "inner", salt=F.col("id")).select("collection", "rep", "_n", "id").dropDuplicates(["collection", "rep", "id"]))
    heads = top_n(copies, ["collection", "rep"], [F.col("id").asc()], k + 1).groupBy("collection", "rep").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.max("_n").alias("_n"))
    tagged = lookup(rows, many.drop("_n"), cls, salt=F.col("id"))
    first = lookup(tagged.filter("id = rep").dropDuplicates(["collection", "rep"]), checkpointed(heads), ["collection", "rep"], "inner").select("collection", "space", "id", "emb", "ids", "_n")
    single = tagged.filter("rep is null").select("collection", "space", "id", "emb", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("long").alias("_n"))

    lists = checkpointed(neighbour_lists(single.unionByName(first), sizes, k, per_root, posts, block))
    alone = lists.filter("_n is null").select("id", F.explode("near").alias("_x"))
    groups = checkpointed(lists.filter("_n is not null").select("collection", F.col("id").alias("rep"), "near", "_n"))
    members = counted_join(copies.drop("_n"), groups, ["collection", "rep"], "_n", F.col("id"))
    each = members.select("id", F.explode(F.slice(F.filter("near", lambda s: s["b"] != F.col("id")), 1, k)).alias("_x"))
    pairs = alone.unionByName(each).filter(F.col("_x.b") != F.col("id"))
    return pairs.select(F.least("id", "_x.b").alias("vec_a"), F.greatest("id", "_x.b").alias("vec_b")).distinct()
