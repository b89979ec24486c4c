"""A collection of records: writes go to its log, reads fold segment and log, ``compact`` makes a new segment."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import embedding as E
from .functions import incremental
from .functions import metadata as M
from .operators import oplog
from .operators.cells import CELL_ROWS, MOST_CELLS, CellIndex, build_cells, search_cells
from .operators.knn import knn, merge
from .operators.rank import leaves
from .operators.where import IndexSchema, combined
from .plans import search as P
from .plans.chunks import checkpointed, range_chunks, row_numbers
from .sources.catalog import Catalog, CatalogError, Conflict, Version

WRITES = ("add", "update", "upsert")
#: Most records of one call with Python lists; larger loads come as DataFrames.
MAX_BATCH = 50_000
#: Cells that a search through the index reads, unless ``config["index"]`` says otherwise.
PROBES = 64


def _meta_json(m: Mapping[str, Any] | None) -> str | None:
    if m is None:
        return None
    M.validate(m)
    plain = {k: {M.TAG: M.SPARSE_TAG, **{x: y for x, y in asdict(v).items() if y is not None}} if isinstance(v, M.SparseVector) else v for k, v in m.items()}
    return json.dumps(plain)


class Collection:
    """Handle of a collection in a catalog; ``version`` is the state it reads."""

    def __init__(self, catalog: Catalog, version: Version) -> None:
        self.catalog, self.version = catalog, version
        ef = version.config.get("embedding_function")
        self.embedder = E.build(ef["name"], ef.get("config")) if ef else None

    @property
    def space(self) -> str:
        return self.version.config.get("space", "l2")

    @property
    def schema(self) -> IndexSchema:
        """What may be filtered and searched: ``config["schema"]`` has disabled (key -> value types), full_text, and
        vector_keys (metadata keys with sparse vectors that may be searched, besides that of ``config["sparse"]``)."""
        s = self.version.config.get("schema", {})
        vectors = {P.W.EMBEDDING, *s.get("vector_keys", ()), *([self.sparse["key"]] if self.sparse else [])}
        return IndexSchema({k: frozenset(v) for k, v in s.get("disabled", {}).items()}, s.get("full_text", True), frozenset(vectors))

    @property
    def sparse(self) -> dict[str, Any]:
        """``config["sparse"]``: the metadata key that gets a BM25 vector of each document, and whether queries use idf."""
        return self.version.config.get("sparse", {})

    def refresh(self) -> Collection:
        """Read the newest version from now on."""
        self.version = self.catalog.at_version(self.version.id)
        return self

    # writes
    def _commit_rows(self, rows: DataFrame, count: int, dimension: int | None = None) -> None:
        v = self.version
        name = self.catalog.write_log(rows)
        self.version = self.catalog.commit(v, logs=(*v.logs, name), log_end=v.log_end + count, dimension=v.dimension or dimension)

    def _write(self, op: str, ids: Sequence[str], embeddings: Sequence | None, metadatas: Sequence | None, documents: Sequence | None) -> None:
        ids = [ids] if isinstance(ids, str) else list(ids)
        if not ids or any(not isinstance(i, str) or not i for i in ids):
            raise ValueError("ids must be non-empty texts")
        if len(set(ids)) < len(ids):
            raise ValueError("ids are repeated in the batch")
        if len(ids) > MAX_BATCH:
            raise ValueError(f"at most {MAX_BATCH} records at once; use write_frame")
        for name, x in (("embeddings", embeddings), ("metadatas", metadatas), ("documents", documents)):
            if x is not None and len(x) != len(ids):
                raise ValueError(f"{name} and ids differ in number")
        n = len(ids)
        docs, metas = list(documents or [None] * n), list(metadatas or [None] * n)
        vecs = [None if e is None else [float(x) for x in e] for e in (embeddings or [None] * n)]
        if self.sparse:
            bm25 = E.Bm25()
            metas = [m if d is None else {**(m or {}), self.sparse["key"]: bm25(d)} for m, d in zip(metas, docs, strict=True)]
        if self.embedder:
            todo = [i for i in range(n) if vecs[i] is None and docs[i] is not None]
            for i, e in zip(todo, self.embedder.encode([docs[i] for i in todo]) if todo else [], strict=True):
                vecs[i] = [float(x) for x in e]
        if op == "add" and any(v is None for v in vecs):
            raise ValueError("add needs embeddings, or documents and an embedding function")
        dims = {len(v) for v in vecs if v is not None} | ({self.version.dimension} - {None})
        if len(dims) > 1:
            raise ValueError(f"embeddings of several dimensions: {sorted(dims)}")
        start = self.version.log_end + 1
        rows = pd.DataFrame({"id": ids, "log_offset": range(start, start + n), "op": op, "document": docs, "embedding": vecs, "metadata": [_meta_json(m) for m in metas]})
        df = self.catalog.spark.createDataFrame(rows, "id string, log_offset bigint, op string, document string, embedding array<float>, metadata string")
        self._commit_rows(df, n, next(iter(dims), None))

    def add(self, ids: Sequence[str], embeddings: Sequence | None = None, metadatas: Sequence | None = None, documents: Sequence | None = None) -> None:
        """New records; ids that exist already are ignored."""
        self._write("add", ids, embeddings, metadatas, documents)

    def update(self, ids: Sequence[str], embeddings: Sequence | None = None, metadatas: Sequence | None = None, documents: Sequence | None = None) -> None:
        """Changes of existing records; other ids are ignored, null metadata values delete their keys."""
        self._write("update", ids, embeddings, metadatas, documents)

    def upsert(self, ids: Sequence[str], embeddings: Sequence | None = None, metadatas: Sequence | None = None, documents: Sequence | None = None) -> None:
        """New records, or changes where they exist."""
        self._write("upsert", ids, embeddings, metadatas, documents)

    def write_frame(self, rows: DataFrame, op: str = "upsert") -> int:
        """Append a DataFrame (id, document, embedding, metadata as JSON text) of any size to the log, in id order.

        As in the calls with lists, documents get their dense and sparse vectors, and repeated ids and embeddings of another
        dimension are errors. Rows without id are left out.
        """
        if op not in WRITES:
            raise ValueError(f"unknown operation {op!r}")
        rows = rows.filter("id is not null").select("id", "document", F.col("embedding").cast("array<float>").alias("embedding"), "metadata")
        if self.embedder:
            rows = E.embed_missing(rows, self.embedder)
        if self.sparse:
            rows = E.with_sparse(rows, self.sparse["key"])
        numbered = checkpointed(row_numbers(range_chunks(rows, ["id"]), [], [F.col("id").asc()], "_n"))
        facts = numbered.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"), F.count_if(F.col("embedding").isNull()).alias("none")).first()
        if op == "add" and facts["none"]:
            raise ValueError("add needs embeddings, or documents and an embedding function")
        dims = {facts["low"], facts["high"], self.version.dimension} - {None}
        if len(dims) > 1:
            raise ValueError(f"embeddings of several dimensions: {sorted(dims)}")
        if numbered.groupBy("id").count().filter("count > 1").limit(1).count():
            raise ValueError("ids are repeated in the frame")
        if facts["n"]:
            self._commit_rows(numbered.withColumn("log_offset", F.col("_n") + self.version.log_end).withColumn("op", F.lit(op)), facts["n"], next(iter(dims), None))
        return facts["n"]

    def delete(self, ids: Sequence[str] | None = None, where: Any = None, where_document: Any = None, limit: int | None = None) -> int:
        """Delete records by ids, by a filter, or both; ``limit`` (the first in natural order) goes with a filter only."""
        if ids is None and where is None and where_document is None:
            raise ValueError("delete needs ids or a filter")
        if limit is not None and where is None and where_document is None:
            raise ValueError("a limit needs a filter")
        gone = P.run_get(self.records(), where, where_document, ids, P.Limit(0, limit), include=())
        rows = oplog.delete_operations(gone, self.version.log_end + 1)
        n = rows.count()
        if n:
            self._commit_rows(rows, n)
        return n

    # reads
    def records(self, level: str = oplog.INDEX_AND_WAL) -> DataFrame:
        """The live records at a read level, as a frame for the plans."""
        v = self.version
        if level == oplog.INDEX_ONLY or not v.logs:
            return oplog.segment_records(self.catalog.read_segment(v))
        log = oplog.read_level(self.catalog.read_log(v), level, v.log_position)
        return oplog.current_records(log, self.catalog.read_segment(v))

    def count(self, where: Any = None, where_document: Any = None, level: str = oplog.INDEX_AND_WAL) -> int:
        """Number of live records (that satisfy a filter)."""
        self.schema.check(combined(where, where_document))
        if where is None and where_document is None:
            v = self.version
            return oplog.count_records(oplog.read_level(self.catalog.read_log(v), level, v.log_position), self.catalog.read_segment(v)).first()["n"]
        return P.run_count(self.records(level), where, where_document).first()["n"]

    def get(self, ids: Any = None, where: Any = None, where_document: Any = None, limit: int | None = None, offset: int = 0, include: Sequence[str] = ("documents", "metadatas"), level: str = oplog.INDEX_AND_WAL) -> DataFrame:
        """Records in natural order."""
        self.schema.check(combined(where, where_document))
        return P.run_get(self.records(level), where, where_document, ids, P.Limit(offset, limit), include)

    def peek(self, n: int = 10) -> DataFrame:
        """The first records."""
        return self.get(limit=n, include=("documents", "metadatas", "embeddings"))

    def query(self, query_embeddings: Sequence | DataFrame | None = None, query_texts: Sequence[str] | None = None, n_results: int = P.DEFAULT_RESULTS, where: Any = None, where_document: Any = None, ids: Any = None, include: Sequence[str] = ("documents", "metadatas", "distances"), level: str = oplog.INDEX_AND_WAL) -> DataFrame:
        """Nearest records of each query vector or text."""
        if (query_embeddings is None) == (query_texts is None):
            raise ValueError("give either query embeddings or query texts")
        self.schema.check(combined(where, where_document))
        if query_texts is not None:
            if self.embedder is None:
                raise ValueError("query texts need an embedding function")
            query_embeddings = self.embedder.encode(list(query_texts))
        if not isinstance(query_embeddings, DataFrame):
            query_embeddings = self.catalog.spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(query_embeddings)], "query_id long, query array<double>")
        finder = self._finder(level, where is not None or where_document is not None or ids is not None) if self.version.index else None
        return P.run_knn(self.records(level), query_embeddings, n_results, self.space, where, where_document, ids, include, finder)

    def _finder(self, level: str, narrowed: bool) -> P.Finder:
        """The search through the cell index: of the folded records those in the probed cells, without the ones that the log
        touches, and of these all; then both are merged."""
        v, opts = self.version, self.version.config["index"]
        index = self.catalog.read_index(v)

        def find(hit: DataFrame, queries: DataFrame, k: int) -> DataFrame:
            rows = index.rows
            fresh = None
            if v.logs and level != oplog.INDEX_ONLY:
                log = oplog.read_level(self.catalog.read_log(v), level, v.log_position)
                rows = rows.join(oplog.touched(log, self.catalog.read_segment(v)).select(F.col("offset_id").alias("id")), "id", "left_anti")
                fresh = knn(oplog.touched(log, hit), queries, k, self.space, id="offset_id")
            if narrowed:
                rows = rows.join(hit.select(F.col("offset_id").alias("id")), "id", "left_semi")
            found = search_cells(CellIndex(rows, index.centres, index.space, index.replicas, index.epsilon), queries, k, opts.get("probes", PROBES), rerank=opts.get("rerank"))
            return found if fresh is None else merge([found, fresh], k)

        return find

    def search(self, plans: P.Search | Mapping | Sequence, level: str = oplog.INDEX_AND_WAL) -> DataFrame | list[DataFrame]:
        """Composed searches: one result for one plan, a list for several."""
        one = not isinstance(plans, (list, tuple))
        records = self.records(level)
        embed = lambda text, key: self.embedder.encode([text])[0] if key == "#embedding" and self.embedder else E.Bm25()(text)
        parsed = [p if isinstance(p, P.Search) else P.Search.from_dict(p) for p in ([plans] if one else plans)]
        for p in parsed:
            self.schema.check(p.filter)
            for x in leaves(p.rank_expr) if p.rank_expr else ():
                self.schema.check_key(x.key)
                if x.key not in (P.W.EMBEDDING, self.sparse.get("key")) and isinstance(x.query, str):
                    raise ValueError(f"a text query needs a vector key, not {x.key!r}")
        idf_keys = [self.sparse["key"]] if self.sparse.get("idf") else []
        out = [P.run_search(records, p, self.space, embed, idf_keys) for p in parsed]
        return out[0] if one else out

    # maintenance
    def compact(self, most_rows: int | None = None) -> Version:
        """Fold the log, or the first ``most_rows`` operations of it, into a new segment and its index, run the attached functions
        over the changes, and publish all as one version."""
        v = self.version
        upto = v.log_end if most_rows is None else min(v.log_end, v.log_position + most_rows)
        log, segment = oplog.fetch_log(self.catalog.read_log(v), v.log_position, upto), self.catalog.read_segment(v)
        done = oplog.materialize(log, segment).persist()
        try:
            text = F.to_json(F.transform_values("metadata", lambda _, x: F.parse_json(x)))
            live = segment.join(done.select("id"), "id", "left_anti").unionByName(done.filter("mat_op <> 'delete_existing'").withColumn("metadata", text).select("id", "offset_id", "document", "embedding", "metadata"))
            name = self.catalog.write_segment(live)
            changed = incremental.changes(done, segment)
            index = self._index_of(done, name)
            functions = {k: {**f, "output": self._run_function(f, changed, log)} for k, f in v.functions.items()}
            total = self.catalog.spark.read.parquet(self.catalog.store.path(name)).count()
            self.version = self.catalog.commit(v, segment=name, index=index, log_position=upto, logs=() if upto == v.log_end else v.logs, total_records=total, functions=functions)
        finally:
            done.unpersist()
        return self.version

    def _index_of(self, done: DataFrame, segment: str) -> str | None:
        """The cell index of a new segment, if ``config["index"]`` asks for one: the last one with the changes, after one round
        of upkeep, or a new one."""
        opts = self.version.config.get("index")
        if opts is None:
            return None
        size, old = opts.get("cell_rows", CELL_ROWS), self.catalog.read_index(self.version)
        if old is not None:
            new = done.filter("mat_op <> 'delete_existing' and embedding is not null").select(F.col("offset_id").alias("id"), F.col("embedding").alias("vector"))
            return self.catalog.write_index(old.changed(done.select(F.col("offset_id").alias("id")), new).maintained(size))
        live = self.catalog.spark.read.parquet(self.catalog.store.path(segment)).filter("embedding is not null")
        n = live.count()
        if not n:
            return None
        built = build_cells(live, min(MOST_CELLS, max(1, round(n / size))), self.space, opts.get("replicas", 2), opts.get("epsilon", 0.3), id="offset_id")
        return self.catalog.write_index(built)

    def _run_function(self, f: Mapping[str, Any], changed: DataFrame, log: DataFrame) -> str:
        before = self.catalog.spark.read.parquet(self.catalog.store.path(f["output"])) if f.get("output") else None
        run = incremental.registered(f["function"])
        out = run(log if f["function"] == "revision_history" else changed, before, **f.get("params", {}))
        name = f"functions/{self.version.id}-{f['function']}-{self.version.log_end}-{self.version.version}"
        out.write.mode("overwrite").parquet(self.catalog.store.path(name))
        return name

    def attach_function(self, name: str, function: str, **params: Any) -> None:
        """Run a registered function over the changes of every compaction from now on."""
        incremental.registered(function)
        if name in self.version.functions:
            raise CatalogError(f"{name!r} is attached already")
        self.version = self.catalog.commit(self.version, functions={**self.version.functions, name: {"function": function, "params": params, "output": None}})

    def detach_function(self, name: str) -> None:
        """Stop running a function."""
        if name not in self.version.functions:
            raise CatalogError(f"{name!r} is not attached")
        self.version = self.catalog.commit(self.version, functions={k: f for k, f in self.version.functions.items() if k != name})

    def function_output(self, name: str) -> DataFrame | None:
        """What an attached function gave at the last compaction."""
        f = self.version.functions.get(name)
        if f is None:
            raise CatalogError(f"{name!r} is not attached")
        return self.catalog.spark.read.parquet(self.catalog.store.path(f["output"])) if f["output"] else None

    def add_input(self, name: str, other: Collection) -> None:
        """Run an attached function over the changes of another collection too; each input keeps its own output."""
        f = self.version.functions.get(name)
        if f is None:
            raise CatalogError(f"{name!r} is not attached")
        other.attach_function(name, f["function"], **f["params"])
        inputs = [*f.get("inputs", []), other.version.id]
        self.version = self.catalog.commit(self.version, functions={**self.version.functions, name: {**f, "inputs": inputs}})

    def function_outputs(self, name: str) -> DataFrame | None:
        """The outputs of a function over all its inputs, with the name of the collection as ``input``."""
        out = None
        every = [self.version, *(self.catalog.at_version(i) for i in self.version.functions[name].get("inputs", []))]
        for c in (Collection(self.catalog, v) for v in every if not v.deleted and name in v.functions):
            part = c.function_output(name)
            if part is not None:
                part = part.withColumn("input", F.lit(c.version.name))
                out = part if out is None else out.unionByName(part)
        return out

    def indexing_status(self) -> DataFrame:
        """Operations folded and not, and the progress."""
        done, end = self.version.log_position, self.version.log_end
        return self.catalog.spark.createDataFrame([(done, end - done, done / end if end else 1.0)], "indexed_ops long, unindexed_ops long, progress double")

    def modify(self, name: str | None = None, metadata: Mapping[str, Any] | None = None) -> None:
        """Rename the collection or replace its metadata."""
        self.version = self.catalog.modify_collection(self.version, name, metadata)

    def fork(self, name: str) -> Collection:
        """A new collection that starts from this one's state."""
        return Collection(self.catalog, self.catalog.fork(self.version, name))

    def transaction(self) -> Transaction:
        """Buffered writes that commit only if no record read in between has changed."""
        return Transaction(self)


class Transaction:
    """Optimistic transaction: remembers which ids were read, buffers one write per id, checks and writes at commit."""

    def __init__(self, collection: Collection) -> None:
        self.collection, self.start = collection, collection.version
        self.read: set[str] = set()
        self.writes: dict[str, tuple] = {}

    def get(self, ids: Sequence[str], include: Sequence[str] = ("documents", "metadatas")) -> DataFrame:
        """Records by id, as of the start of the transaction; they may not change until its commit."""
        self.read.update(ids)
        return Collection(self.collection.catalog, self.start).get(list(ids), include=include)

    def _buffer(self, op: str, id: str, embedding: Any, metadata: Any, document: Any) -> None:
        if id in self.writes:
            raise ValueError(f"{id!r} is written already in this transaction")
        self.writes[id] = (op, None if embedding is None else [float(x) for x in embedding], _meta_json(metadata), document)

    def add(self, id: str, embedding: Any = None, metadata: Any = None, document: Any = None) -> None:
        self._buffer("add", id, embedding, metadata, document)

    def update(self, id: str, embedding: Any = None, metadata: Any = None, document: Any = None) -> None:
        self._buffer("update", id, embedding, metadata, document)

    def upsert(self, id: str, embedding: Any = None, metadata: Any = None, document: Any = None) -> None:
        self._buffer("upsert", id, embedding, metadata, document)

    def delete(self, id: str) -> None:
        self._buffer("delete", id, None, None, None)

    def commit(self) -> None:
        """Write all at once; Conflict if a read record was written by someone else since the start."""
        c = self.collection.refresh()
        watched = sorted(self.read | self.writes.keys())
        if c.version.version != self.start.version and watched:
            if c.version.log_position > self.start.log_end:
                raise Conflict("the log was compacted past the transaction's start")
            newer = c.catalog.read_log(c.version).filter(F.col("log_offset") > self.start.log_end)
            if newer.filter(F.col("id").isin(*watched)).limit(1).count():
                raise Conflict("a record of the transaction was changed by another writer")
        if not self.writes:
            return
        rows = [(i, c.version.log_end + n, w[0], w[3], w[1], w[2]) for n, (i, w) in enumerate(self.writes.items(), 1)]
        c._commit_rows(c.catalog.spark.createDataFrame(rows, "id string, log_offset bigint, op string, document string, embedding array<float>, metadata string"), len(rows))
