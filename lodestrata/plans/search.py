"""The read plans over a frame of records: count, get, nearest neighbours and composed search.

A record frame has ``id`` (string), ``offset_id`` (long, the natural order), ``document``, ``embedding`` and ``metadata`` (a META
map). A plan is a small immutable description; ``run_*`` turns it into one lazily built DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..operators import where as W
from ..operators.knn import knn
from ..operators.rank import Knn, Rank, parse_rank, rank_rows
from ..operators.sparse import idf, rescale, sparse_knn
from .chunks import CHUNK, range_chunks, row_numbers

#: Metadata key under which a record's URI travels.
URI_KEY = "#uri"
DEFAULT_RESULTS = 10
#: Rows of a page that one window numbers.
PAGE_ROWS = 100_000


class PlanError(ValueError):
    """A malformed plan."""


@dataclass(frozen=True)
class Limit:
    """Skip ``offset`` rows, then take ``limit`` (None: all)."""

    offset: int = 0
    limit: int | None = None

    def __post_init__(self) -> None:
        if self.offset < 0 or (self.limit is not None and self.limit < 0):
            raise PlanError("offset and limit must not be negative")

    @staticmethod
    def from_dict(d: Mapping[str, Any]) -> Limit:
        if set(d) - {"offset", "limit"}:
            raise PlanError(f"malformed limit {d!r}")
        return Limit(d.get("offset", 0), d.get("limit"))

    def to_dict(self) -> dict:
        return {"offset": self.offset} | ({} if self.limit is None else {"limit": self.limit})


@dataclass(frozen=True)
class Aggregate:
    """Keep the ``k`` smallest (``$min_k``) or largest (``$max_k``) rows of a group by a list of keys."""

    op: str
    keys: tuple[str, ...]
    k: int

    def __post_init__(self) -> None:
        if self.op not in ("$min_k", "$max_k"):
            raise PlanError(f"unknown aggregate {self.op!r}")
        if not self.keys or self.k < 1:
            raise PlanError("an aggregate needs keys and a positive k")
        if any(k.startswith("#") and k != W.SCORE for k in self.keys):
            raise PlanError("an aggregate's keys are metadata fields or #score")

    @staticmethod
    def from_dict(d: Mapping[str, Any]) -> Aggregate:
        if len(d) != 1:
            raise PlanError(f"malformed aggregate {d!r}")
        ((op, v),) = d.items()
        keys = v.get("keys", [])
        return Aggregate(op, tuple([keys] if isinstance(keys, str) else keys), v.get("k", 0))

    def to_dict(self) -> dict:
        return {self.op: {"keys": list(self.keys), "k": self.k}}


def MinK(keys: str | Sequence[str], k: int) -> Aggregate:
    """Smallest ``k`` per group."""
    return Aggregate("$min_k", (keys,) if isinstance(keys, str) else tuple(keys), k)


def MaxK(keys: str | Sequence[str], k: int) -> Aggregate:
    """Largest ``k`` per group."""
    return Aggregate("$max_k", (keys,) if isinstance(keys, str) else tuple(keys), k)


@dataclass(frozen=True)
class GroupBy:
    """Groups of the ranked rows by metadata fields, and what is kept of each."""

    keys: tuple[str, ...]
    aggregate: Aggregate

    def __post_init__(self) -> None:
        if not self.keys or self.aggregate is None:
            raise PlanError("a group-by needs keys and an aggregate")
        if any(k.startswith("#") for k in self.keys):
            raise PlanError("groups are by metadata fields only")

    @staticmethod
    def from_dict(d: Mapping[str, Any] | None) -> GroupBy | None:
        if not d:
            return None
        if set(d) != {"keys", "aggregate"}:
            raise PlanError("a group-by has keys and an aggregate")
        keys = d["keys"]
        return GroupBy((keys,) if isinstance(keys, str) else tuple(keys), Aggregate.from_dict(d["aggregate"]))

    def to_dict(self) -> dict:
        return {"keys": list(self.keys), "aggregate": self.aggregate.to_dict()}


@dataclass(frozen=True)
class Select:
    """What a result row holds: any of #document, #embedding, #metadata, #score and single metadata fields."""

    keys: frozenset[str] = frozenset()

    @staticmethod
    def from_dict(d: Mapping[str, Any] | Sequence[str]) -> Select:
        return Select(frozenset(d["keys"] if isinstance(d, Mapping) else d))

    def to_dict(self) -> dict:
        return {"keys": sorted(self.keys)}


ALL = Select(frozenset({W.DOCUMENT, W.EMBEDDING, W.METADATA, W.SCORE}))


@dataclass(frozen=True)
class Search:
    """A composed search; every builder call gives a new one."""

    filter: W.Where | None = None
    rank_expr: Rank | None = None
    group: GroupBy | None = None
    page: Limit = field(default_factory=Limit)
    fields: Select = field(default_factory=Select)
    ids: tuple[str, ...] | None = None

    def where(self, w: Any) -> Search:
        return replace(self, filter=W.parse_where(w))

    def only_ids(self, ids: Sequence[str]) -> Search:
        return replace(self, ids=tuple(ids))

    def rank(self, r: Any) -> Search:
        return replace(self, rank_expr=parse_rank(r))

    def group_by(self, g: GroupBy | Mapping[str, Any]) -> Search:
        return replace(self, group=g if isinstance(g, GroupBy) else GroupBy.from_dict(g))

    def limit(self, limit: int | Limit | Mapping | None, offset: int = 0) -> Search:
        page = limit if isinstance(limit, Limit) else Limit.from_dict(limit) if isinstance(limit, Mapping) else Limit(offset, limit)
        return replace(self, page=page)

    def select(self, *keys: Any) -> Search:
        return replace(self, fields=Select(frozenset(getattr(k, "name", k) for k in keys)))

    def select_all(self) -> Search:
        return replace(self, fields=ALL)

    def to_dict(self) -> dict:
        return {
            "filter": self.filter.to_dict() if self.filter else {},
            "rank": self.rank_expr.to_dict() if self.rank_expr else {},
            "group_by": self.group.to_dict() if self.group else {},
            "limit": self.page.to_dict(),
            "select": self.fields.to_dict(),
        }

    @staticmethod
    def from_dict(d: Mapping[str, Any]) -> Search:
        s = Search().where(d.get("filter")).rank(d.get("rank") or None).limit(Limit.from_dict(d.get("limit", {})))
        s = replace(s, fields=Select.from_dict(d.get("select", {"keys": []})))
        return replace(s, group=GroupBy.from_dict(d.get("group_by")))


#: A search for the nearest of some records: (records, queries, k) to (query_id, id, distance, rank).
Finder = Callable[[DataFrame, DataFrame, int], DataFrame]


def filtered(records: DataFrame, where: W.Where | None = None, ids: Any = None, binding: W.Binding | None = None) -> DataFrame:
    """The records that satisfy the predicate and the allow-list; without either, ``records`` itself."""
    out = W.filter_ids(records, ids)
    return out if where is None else out.filter(W.compile_where(where, binding or W.MapBinding()))


def run_count(records: DataFrame, where: Any = None, where_document: Any = None, ids: Any = None) -> DataFrame:
    """One row ``n``: how many records satisfy the filter."""
    return filtered(records, W.combined(where, where_document), ids).agg(F.count(F.lit(1)).alias("n"))


def paged(df: DataFrame, page: Limit, *order: Column) -> DataFrame:
    """A page of ``df`` in a total order (a global top-k, not a full sort, if it is limited)."""
    out = df.orderBy(*order)
    out = out.offset(page.offset) if page.offset else out
    return out if page.limit is None else out.limit(page.limit)


def numbered(rows: DataFrame, limit: int | None, *order: Column) -> DataFrame:
    """``rows`` with their ``rank`` in a total order: of a page in one window, of more across range chunks."""
    if limit is not None and limit <= PAGE_ROWS:
        return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return row_numbers(range_chunks(rows, order), [], order, "rank").drop(CHUNK)


def run_get(records: DataFrame, where: Any = None, where_document: Any = None, ids: Any = None, page: Limit = Limit(), include: Sequence[str] = ("documents", "metadatas")) -> DataFrame:
    """Records in natural order: id and the included columns."""
    columns = {"documents": "document", "metadatas": "metadata", "embeddings": "embedding"}
    if bad := set(include) - {*columns, "distances", "uris", "data"}:
        raise PlanError(f"cannot include {sorted(bad)}")
    hit = filtered(records, W.combined(where, where_document), ids)
    cols = [columns[i] for i in columns if i in include]
    if "uris" in include:
        hit = hit.withColumn("uri", F.try_element_at("metadata", F.lit(URI_KEY))["s"])
        cols.append("uri")
    return paged(hit.select("offset_id", "id", *cols), page, F.col("offset_id").asc()).drop("offset_id")


def run_knn(records: DataFrame, queries: DataFrame, k: int = DEFAULT_RESULTS, space: str = "l2", where: Any = None, where_document: Any = None, ids: Any = None, include: Sequence[str] = ("documents", "metadatas", "distances"), finder: Finder | None = None) -> DataFrame:
    """(query_id, rank, id, ...): the ``k`` nearest records for each of many query vectors under one filter.

    The candidates are found on ids and vectors only, exactly or by ``finder`` (records, queries, k); documents and metadata
    are joined to the few results.
    """
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise PlanError("the number of results must be a positive integer")
    hit = filtered(records, W.combined(where, where_document), ids)
    found = (knn(hit, queries, k, space, id="offset_id", vector="embedding") if finder is None else finder(hit, queries, k)).withColumnRenamed("id", "offset_id")
    columns = {"documents": "document", "metadatas": "metadata", "embeddings": "embedding"}
    body = hit.select("offset_id", "id", *[columns[i] for i in columns if i in include])
    cols = ["query_id", "rank", "id", *[columns[i] for i in columns if i in include], *(["distance"] if "distances" in include else [])]
    return found.join(body, "offset_id").select(*cols)


def _meta_sort(name: str, ascending: bool) -> list[Column]:
    v = F.col(f"_m_{name}")
    parts = [v["t"], v["b"], F.coalesce(v["f"], v["i"].cast("double")), v["i"], v["s"]]
    # Integers and floats compare as numbers: they share a place in the order of types.
    parts[0] = F.when(v["t"] == M.FLOAT, M.INT).otherwise(v["t"])
    return [p.asc_nulls_first() if ascending else p.desc_nulls_last() for p in parts]


def regroup(scored: DataFrame, g: GroupBy) -> DataFrame:
    """The rows that the aggregate keeps of each group; ``scored`` has id, offset_id, score and metadata.

    A missing field is a value: it forms a group of its own, sorts first ascending and last descending. Ties go to the
    smaller score, then the smaller offset id.
    """
    names = {k for k in (*g.keys, *g.aggregate.keys) if k != W.SCORE}
    wide = scored.withColumns({f"_m_{n}": F.try_element_at("metadata", F.lit(n)) for n in names})
    up = g.aggregate.op == "$min_k"
    order: list[Column] = []
    for k in g.aggregate.keys:
        order += [F.col("score").asc_nulls_first() if up else F.col("score").desc_nulls_last()] if k == W.SCORE else _meta_sort(k, up)
    w = Window.partitionBy(*[F.col(f"_m_{k}") for k in g.keys]).orderBy(*order, F.col("score").asc(), F.col("offset_id").asc())
    return wide.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= g.aggregate.k).drop("_n", *[f"_m_{n}" for n in names])


def _postings(rows: DataFrame, key: str) -> DataFrame:
    """(id, dim, weight) of the sparse vectors under a metadata key."""
    v = F.try_element_at("metadata", F.lit(key))["sv"]
    zipped = F.explode(F.arrays_zip(v["indices"].alias("dim"), v["values"].alias("weight"))).alias("_z")
    return rows.select(F.col("offset_id").alias("id"), zipped).select("id", F.col("_z.dim").alias("dim"), F.col("_z.weight").cast("double").alias("weight"))


def run_search(records: DataFrame, plan: Search, space: str = "l2", embed: Callable[[str, str], Any] | None = None, idf_keys: Sequence[str] = ()) -> DataFrame:
    """(id, document?, embedding?, metadata?, score?) by (score, offset id), ``rank`` from 1 telling the order.

    The filter applies to every leaf. Without a rank expression rows come in natural order and their score is their position.
    ``embed`` turns a text query of a leaf into a vector. Queries of the sparse keys in ``idf_keys`` are first rescaled by the
    rarity of their dimensions in the whole collection, whatever the filter.
    """
    if plan.group is not None and plan.rank_expr is None:
        raise PlanError("a group-by needs a rank expression")
    spark = records.sparkSession
    hit = filtered(records, plan.filter, plan.ids)

    def leaf(x: Knn) -> DataFrame:
        q = embed(x.query, x.key) if isinstance(x.query, str) and embed else x.query
        if isinstance(q, str):
            raise PlanError("a text query needs an embedding function")
        if x.key == W.EMBEDDING:
            one = spark.createDataFrame([(0, [float(v) for v in q])], "query_id long, query array<double>")
            return knn(hit, one, x.limit, space, id="offset_id").select("id", "distance", "rank")
        s = q if isinstance(q, M.SparseVector) else M.SparseVector(tuple(q["indices"]), tuple(q["values"]))
        asked = spark.createDataFrame([(0, i, float(w)) for i, w in zip(s.indices, s.values, strict=True)], "query_id long, dim long, weight double")
        if x.key in idf_keys:
            size = records.count()
            asked = rescale(asked, idf(_postings(records, x.key).filter(F.col("dim").isin(*s.indices)), size), size)
        return sparse_knn(_postings(hit, x.key), asked, x.limit).select("id", "distance", "rank")

    if plan.rank_expr is None:
        page = paged(hit.select("offset_id"), plan.page, F.col("offset_id").asc())
        scored = numbered(page, plan.page.limit, F.col("offset_id").asc()).withColumn("score", (F.col("rank") - 1).cast("double")).drop("rank")
    else:
        empty = hit.select(F.col("offset_id").alias("id"), F.lit(0.0).alias("score"))
        scored = rank_rows(plan.rank_expr, leaf, empty).withColumnRenamed("id", "offset_id")
        if plan.group is not None:
            scored = regroup(scored.join(hit.select("offset_id", "metadata"), "offset_id"), plan.group).select("offset_id", "score")
        scored = paged(scored, plan.page, F.col("score").asc_nulls_last(), F.col("offset_id").asc())
    scored = numbered(scored, plan.page.limit, F.col("score").asc_nulls_last(), F.col("offset_id").asc())
    return project(scored.join(hit, "offset_id"), plan.fields)


def project(rows: DataFrame, fields: Select) -> DataFrame:
    """Result rows: rank, id and the selected fields; single metadata fields make a map of these only."""
    cols = ["rank", "id"]
    cols += [c for k, c in ((W.DOCUMENT, "document"), (W.EMBEDDING, "embedding")) if k in fields.keys]
    single = sorted(k for k in fields.keys if not k.startswith("#"))
    if W.METADATA in fields.keys:
        cols.append("metadata")
    elif single:
        rows = rows.withColumn("metadata", F.map_filter("metadata", lambda k, _: k.isin(*single)))
        cols.append("metadata")
    return rows.select(*cols, *(["score"] if W.SCORE in fields.keys else []))
