"""Queries that go through a catalog: loads, changes, compaction, searches and functions of collections, with their SQL.

Every query makes a catalog of its own in the session's shared folder and works on the whole embeddings or documents table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..collection import Collection
from ..functions import incremental

from ..functions import text as T
from ..operators import oplog
from ..operators.cells import build_cells, search_cells
from ..operators.knn import knn, merge
from ..operators.phrase import phrase_ids, trigram_postings
from ..operators.rank import Knn, fuse, rank_rows
from ..operators.sparse import bm25_weights, sparse_knn
from ..operators.where import filter_ids
from ..plans import search as P
from ..plans.chunks import checkpointed, shared_folder
from ..sources.catalog import Catalog, Conflict
from ..sources.tables import table
from . import retrieval as R

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _catalog(spark: SparkSession) -> Catalog:
    return Catalog(spark, f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings as rows to load: id, document, embedding, metadata (JSON)."""
    e = table(spark, sf, "embeddings")
    return e.select(F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("id"), F.concat(F.lit("item "), F.col("vec_id")).alias("document"), "embedding", F.to_json(F.struct("label")).alias("metadata"))


#: Collections that a session has made, by application, tables and state; queries that change one work on a fork of it.
_MADE: dict[tuple, Collection] = {}


def _loaded(spark: SparkSession, sf: str) -> Collection:
    """The items, in the log."""
    key = (spark.sparkContext.applicationId, sf, "loaded")
    if key not in _MADE:
        cat = _catalog(spark)
        c = Collection(cat, cat.create_collection("items"))
        c.write_frame(_items(spark, sf), "add")
        _MADE[key] = c
    return _MADE[key].fork(f"fork-{uuid.uuid4().hex}")


def _folded(spark: SparkSession, sf: str) -> Collection:
    """The items, in a segment with a cell index."""
    key = (spark.sparkContext.applicationId, sf, "folded")
    if key not in _MADE:
        cat = _catalog(spark)
        c = Collection(cat, cat.create_collection("items", config={"space": "l2", "index": {"cell_rows": 100, "probes": 1 << 20}}))
        c.write_frame(_items(spark, sf), "add")
        c.compact()
        _MADE[key] = c
    return _MADE[key].fork(f"fork-{uuid.uuid4().hex}")


def _changed(spark: SparkSession, sf: str) -> Collection:
    """The folded items; then in the log: labels of 1 up by 10, those of 3 deleted, copies of every fiftieth under new ids,
    and adds of ids that are there."""
    key = (spark.sparkContext.applicationId, sf, "changed")
    if key not in _MADE:
        c = _folded(spark, sf)
        rows, none = _items(spark, sf), F.lit(None)
        label = F.get_json_object("metadata", "$.label").cast("int")
        c.write_frame(rows.filter(label == 1).select("id", none.cast("string").alias("document"), none.cast("array<float>").alias("embedding"), F.to_json(F.struct((label + 10).alias("label"), F.lit(True).alias("seen"))).alias("metadata")), "update")
        c.delete(where={"label": 3})
        c.write_frame(rows.filter(F.col("id").cast("long") % 50 == 0).withColumn("id", F.concat(F.lit("new-"), "id")), "upsert")
        c.write_frame(rows.filter((F.col("id").cast("long") % 40 == 0) & (label != 3)).withColumn("document", F.lit("ignored")), "add")
        _MADE[key] = c
    return _MADE[key].fork(f"fork-{uuid.uuid4().hex}")


def _rows(found: DataFrame) -> DataFrame:
    return found.select("id", "document", F.col("metadata")["label"]["i"].alias("label"), F.coalesce(F.try_element_at("metadata", F.lit("seen"))["b"], F.lit(False)).alias("seen"))


_ID = "lpad(vec_id::VARCHAR, 9, '0')"
_ITEMS = f"SELECT {_ID} AS id, 'item ' || vec_id AS document, label::BIGINT AS label, false AS seen FROM embeddings"
_AFTER = f"""SELECT {_ID} AS id, 'item ' || vec_id AS document, CASE WHEN label = 1 THEN 11 ELSE label END::BIGINT AS label, label = 1 AS seen FROM embeddings WHERE label <> 3
    UNION ALL SELECT 'new-' || {_ID}, 'item ' || vec_id, label::BIGINT, false FROM embeddings WHERE vec_id % 50 = 0"""


@query(_ITEMS)
def collection_load(spark, sf):
    """A bulk load into a collection's log, read back through the log."""
    return _rows(_loaded(spark, sf).get())


@query(_AFTER)
def collection_changes(spark, sf):
    """Adds, updates, deletes by a filter and upserts in the log over a compacted segment."""
    return _rows(_changed(spark, sf).get())


@query(_AFTER)
def collection_compacted(spark, sf):
    """The same after a second compaction, from the segment alone."""
    c = _changed(spark, sf)
    c.compact()
    return _rows(c.get(level=oplog.INDEX_ONLY))


@query(_ITEMS)
def collection_index_only(spark, sf):
    """A read of the compacted part, while changes wait in the log."""
    return _rows(_changed(spark, sf).get(level=oplog.INDEX_ONLY))


@query(f"SELECT count(*) AS n, count(CASE WHEN seen THEN 1 END) AS seen FROM ({_AFTER})")
def collection_count(spark, sf):
    c = _changed(spark, sf)
    return spark.createDataFrame([(c.count(), c.count(where={"seen": True}))], "n long, seen long")


@query(f"SELECT id, document, label, seen FROM (SELECT *, row_number() OVER (ORDER BY id) AS k FROM ({_ITEMS})) WHERE k > 15 AND k <= 40")
def collection_page(spark, sf):
    """A page in natural order."""
    return _rows(_loaded(spark, sf).get(limit=25, offset=15))


@query(f"WITH a AS ({_AFTER}) SELECT id, true AS was_there FROM a UNION ALL SELECT 'fork-1', false")
def collection_fork(spark, sf):
    """A fork has what its origin had, and its own changes, which the origin does not get."""
    c = _changed(spark, sf)
    f = c.fork("copy")
    f.add(["fork-1"], [[0.0] * c.version.dimension])
    return f.get(include=()).join(c.get(include=()).withColumn("_t", F.lit(True)), "id", "left").select("id", F.coalesce("_t", F.lit(False)).alias("was_there"))


@query("SELECT tenant, database_name, collection_id, dim, space_name FROM collections")
def catalog_collections(spark, sf):
    """Tenants, databases and collections of the table, made in a catalog and listed from it."""
    cat, out = _catalog(spark), []
    rows = table(spark, sf, "collections").select("tenant", "database_name", "collection_id", "dim", "space_name").collect()  # a catalogue
    for t in {r["tenant"] for r in rows}:
        cat.create_tenant(t, exist_ok=True)
        for d in {r["database_name"] for r in rows if r["tenant"] == t}:
            cat.create_database(d, t, exist_ok=True)
    for r in rows:
        cat.create_collection(r["collection_id"], {"dim": r["dim"]}, {"space": r["space_name"]}, tenant=r["tenant"], database=r["database_name"])
    for t, d in {(r["tenant"], r["database_name"]) for r in rows}:
        found = cat.list_collections(tenant=t, database=d)
        assert len(found) == cat.count_collections(t, d)
        out += [(t, d, v.name, v.metadata["dim"], v.config["space"]) for v in found]
    return spark.createDataFrame(out, "tenant string, database_name string, collection_id string, dim int, space_name string")


@query("SELECT 'committed' AS outcome, 'both' AS document UNION ALL SELECT 'conflict', 'theirs'")
def collection_transactions(spark, sf):
    """A transaction whose records nobody changed commits; one whose records were changed meanwhile does not."""
    c, out = _loaded(spark, sf), []
    t = c.transaction()
    t.get(["000000001"])
    t.update("000000001", document="both")
    t.commit()
    out.append(("committed", c.get(["000000001"]).first()["document"]))
    t = c.transaction()
    t.get(["000000002"])
    t.update("000000002", document="mine")
    Collection(c.catalog, c.catalog.at_version(c.version.id)).update(["000000002"], documents=["theirs"])
    try:
        t.commit()
        outcome = "lost update"
    except Conflict:
        outcome = "conflict"
    return spark.createDataFrame([*out, (outcome, c.refresh().get(["000000002"]).first()["document"])], "outcome string, document string")


@query(f"SELECT count(*) AS total_count, sum(CASE WHEN label = 11 THEN 1 ELSE 0 END)::BIGINT AS elevens FROM ({_AFTER})")
def collection_functions(spark, sf):
    """A counter and statistics attached before the first load, after two compactions."""
    cat = _catalog(spark)
    c = Collection(cat, cat.create_collection("items"))
    c.attach_function("count", "record_counter")
    c.attach_function("stats", "statistics")
    c.write_frame(_items(spark, sf), "add")
    c.compact()
    label = F.get_json_object("metadata", "$.label").cast("int")
    rows, none = _items(spark, sf), F.lit(None)
    c.write_frame(rows.filter(label == 1).select("id", none.cast("string").alias("document"), none.cast("array<float>").alias("embedding"), F.to_json(F.struct((label + 10).alias("label"))).alias("metadata")), "update")
    c.delete(where={"label": 3})
    c.write_frame(rows.filter(F.col("id").cast("long") % 50 == 0).withColumn("id", F.concat(F.lit("new-"), "id")), "upsert")
    c.compact()
    stats = incremental.read_statistics(c.function_output("stats"), "label")["statistics"]["label"]
    total = c.function_output("count").first()["total_count"]
    return spark.createDataFrame([(total, stats.get("11", {"count": 0})["count"])], "total_count long, elevens long")


_OURS = "(SELECT vec_id, embedding FROM embeddings WHERE label <> 3)"


@query(f"""SELECT query_id, id, round(d, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), place) AS rank
    FROM (SELECT q.vec_id AS query_id, e.id, e.place, {R._L2} AS d FROM embeddings q, (SELECT {_ID} AS id, vec_id AS place, embedding FROM {_OURS}
      UNION ALL SELECT 'new-' || {_ID}, 1000000000 + vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0) e WHERE q.vec_id % 20 = 0)) WHERE rank <= 5""")
def collection_query(spark, sf):
    """Nearest records through the kept cell index, all cells probed, with the changes in the log searched in full."""
    c = _changed(spark, sf)
    asked = table(spark, sf, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return c.query(query_embeddings=asked, n_results=5, include=("distances",)).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


def _recall(spark: SparkSession, sf: str, rerank: int | None) -> DataFrame:
    c = R._corpus(spark, sf)
    asked = checkpointed(R._asked(c))
    true = knn(c, asked, 5, "l2").select("query_id", "id")
    found = search_cells(build_cells(c, 16), asked, 5, R.PROBES, rerank=rerank).select("query_id", "id")
    hits = true.join(found.withColumn("_hit", F.lit(1)), ["query_id", "id"], "left").agg((F.count("_hit") / F.count(F.lit(1)) >= 0.9).alias("recall_90"))
    return asked.agg(F.count(F.lit(1)).alias("queries")).crossJoin(hits)


@query("SELECT count(*) AS queries, true AS recall_90 FROM embeddings WHERE vec_id % 20 = 0")
def ivf_recall(spark, sf):
    """Whether the cell search finds 0.9 of the nearest five of all stated queries."""
    return _recall(spark, sf, None)


@query("SELECT count(*) AS queries, true AS recall_90 FROM embeddings WHERE vec_id % 20 = 0")
def quantized_recall(spark, sf):
    """The same with candidates chosen by their one-bit codes."""
    return _recall(spark, sf, 200)


# Documents: a small dense vector (shares of eight letters) besides the BM25 weights.
_LETTERS = "etaoinsr"


def _letters(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower("text")
    share = [((F.length(low) - F.length(F.replace(low, F.lit(x), F.lit("")))) / F.length(low)).cast("float") for x in _LETTERS]
    return table(spark, sf, "documents").filter("length(text) > 0").select(F.col("doc_id").alias("id"), F.array(*share).alias("embedding"))


_DENSE = "v AS (SELECT doc_id AS id, [" + ", ".join(f"((length(lower(text)) - length(replace(lower(text), '{x}', ''))) / length(lower(text)))::FLOAT" for x in _LETTERS) + "] AS e FROM documents WHERE length(text) > 0)"


@query(f"""{R._TF}, {_DENSE},
    da AS (SELECT q.id AS query_id, v.id, list_sum(list_transform(range(1, 9), lambda i: (q.e[i]::DOUBLE - v.e[i]::DOUBLE) ** 2)) AS d FROM v q, v WHERE q.id % 20 = 0),
    dr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS r FROM da),
    sa AS (SELECT q.id AS query_id, w.id, 1 - sum(w.weight * q.weight) AS d FROM wt w JOIN wt q ON w.dim = q.dim WHERE q.id % 20 = 0 GROUP BY q.id, w.id),
    sr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS r FROM sa),
    f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, -(coalesce(2 / (60 + a.r - 1), 2 / 1060.0) + coalesce(1 / (60 + b.r - 1), 1 / 1060.0)) AS score
      FROM (SELECT * FROM dr WHERE r <= 30) a FULL JOIN (SELECT * FROM sr WHERE r <= 30) b ON a.query_id = b.query_id AND a.id = b.id)
    SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12), id) AS rank FROM f) WHERE rank <= 10""")
def hybrid_search(spark, sf):
    """Dense and BM25 rankings of the documents fused, every twentieth document being a query."""
    v = checkpointed(_letters(spark, sf))
    w = checkpointed(bm25_weights(table(spark, sf, "documents"), "doc_id", "text", stem=False))
    dense = knn(v, v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query")), 30, "l2")
    sparse = sparse_knn(w, w.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "dim", "weight"), 30)
    return fuse([dense, sparse], [2.0, 1.0], 60.0, 1000.0, 10).withColumn("score", F.round("score", 6))


@query("SELECT doc_id FROM documents WHERE contains(text, 'collection')")
def phrase_join(spark, sf):
    """A phrase through positional trigram postings."""
    return phrase_ids(trigram_postings(table(spark, sf, "documents"), "doc_id", "text"), "collection").select(F.col("id").alias("doc_id"))


@query("SELECT vec_id::VARCHAR AS id, 'label' AS key, label::VARCHAR AS value FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id::VARCHAR, 'parity', 'even' FROM embeddings WHERE vec_id % 2 = 0")
def metadata_join(spark, sf):
    """Records with their metadata as rows, where another metadata row says so: a left join and an IN subquery."""
    r = R._records(spark, sf)
    meta = r.select("id", F.explode(incremental.value_rows(F.col("metadata"))).alias("_m")).select("id", "_m.key", "_m.value")
    r.createOrReplaceTempView("ls_records")
    meta.createOrReplaceTempView("ls_metadata")
    return spark.sql("SELECT r.id, m.key, m.value FROM ls_records r LEFT JOIN ls_metadata m ON r.id = m.id WHERE r.id IN (SELECT id FROM ls_metadata WHERE key = 'parity' AND value = 'even')")


@query("SELECT doc_id FROM documents WHERE contains(text, 'shard') AND NOT coalesce(lang = 'en', false) AND doc_id % 3 = 0")
def filter_documents_and_ids(spark, sf):
    """A document predicate inside a metadata predicate, with an allow-list of ids in a table (a left-semi join)."""
    docs = table(spark, sf, "documents")
    hit = R._docs(spark, sf, {"$and": [{"#document": {"$contains": "shard"}}, {"lang": {"$ne": "en"}}]})
    return filter_ids(hit, docs.filter("doc_id % 3 = 0").select("doc_id"), "doc_id").select("doc_id")


_SHARDED = "SELECT vec_id::VARCHAR AS id, vec_id % 3 AS shard, row_number() OVER (ORDER BY vec_id % 3, vec_id) AS k FROM embeddings WHERE label <> 2"


@query(f"SELECT id FROM ({_SHARDED}) WHERE k > 20 AND k <= 50")
def get_across_shards(spark, sf):
    """A page over shards: each gives its first offset + limit rows, the page is cut from these in shard order."""
    r, out = R._records(spark, sf), None
    for n in range(3):
        part = P.paged(P.filtered(r.filter(F.col("offset_id") % 3 == n), P.W.parse_where({"label": {"$ne": 2}})).select("id", "offset_id", F.lit(n).alias("shard")), P.Limit(0, 50), F.col("offset_id").asc())
        out = part if out is None else out.unionByName(part)
    return P.paged(out, P.Limit(20, 30), F.col("shard").asc(), F.col("offset_id").asc()).select("id")


@query(f"""WITH {R._leaf_sql('a', 42, 100)}, m AS (SELECT a.id, a.d, e.label FROM a JOIN embeddings e ON a.id = e.vec_id), g AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, id) AS k FROM m)
    SELECT id::VARCHAR AS id, round(d, 6) AS score FROM g WHERE k <= 3""")
def regroup_across_shards(spark, sf):
    """A search by groups over shards: the shards' nearest are merged, then grouped anew."""
    r = R._records(spark, sf)
    q = table(spark, sf, "embeddings").filter("vec_id = 42").select(F.lit(0).cast("long").alias("query_id"), F.col("embedding").alias("query"))
    near = merge([knn(r.filter(F.col("offset_id") % 3 == n), q, 100, "l2", id="offset_id") for n in range(3)], 100)
    scored = rank_rows(Knn(0, limit=100), lambda _: near.select("id", "distance", "rank"), r.select(F.col("offset_id").alias("id"), F.lit(0.0).alias("score"))).withColumnRenamed("id", "offset_id")
    kept = P.regroup(scored.join(r.select("offset_id", "id", "metadata"), "offset_id"), P.GroupBy(("label",), P.MinK("#score", 3)))
    return kept.select("id", F.round("score", 6).alias("score"))


@query("""WITH last AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events)
    SELECT event_type AS value, count(*) AS count FROM last WHERE k = 1 AND event_type <> 'error' GROUP BY event_type""")
def get_statistics(spark, sf):
    """One key of the statistics, as the reader gives it."""
    first, second = R._changes(spark, sf)
    found = incremental.read_statistics(incremental.statistics(second, incremental.statistics(first)), "kind")["statistics"]["kind"]
    return spark.createDataFrame([(v, c["count"]) for v, c in found.items()], "value string, count long")


@query("""SELECT user_id || '::v' || v AS id, v AS version, CASE WHEN event_type <> 'error' THEN v + 6 END AS source_version, event_type = 'error' AS is_delete
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS v FROM events)""")
def revision_versions(spark, sf):
    """Own version numbers, beginning at 7, through two steps that overlap: rows that were kept before add nothing."""
    n = F.row_number().over(P.Window.partitionBy("user_id").orderBy("event_id")) + 6  # the events of one user: a test input
    numbers = table(spark, sf, "events").select((F.col("event_id") + 1).alias("log_offset"), n.cast("long").alias("source_version"))
    log = R._events(spark, sf).join(numbers, "log_offset")
    first = checkpointed(incremental.revision_history(log.filter("log_offset <= 400"), version_key="v"))
    late = log.filter("log_offset > 400")
    both = incremental.revision_history(late, first, version_key="v")
    return both.select("id", "version", "source_version", "is_delete")


_SPACE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(rf"""SELECT doc_id, md5(regexp_replace(text, '{_SPACE}', '', 'g')) AS body_md5, true AS within_limit,
    md5(coalesce(list_filter(string_split(text, chr(10)), lambda l: regexp_replace(l, '{_SPACE}', '', 'g') <> '')[1], ' ')) AS title_md5 FROM documents WHERE text IS NOT NULL""")
def markdown_whole(spark, sf):
    """What the chunks of each page come to: the title as it stands, the whole text but for blanks, chunks within the limit."""
    c = T.chunks(table(spark, sf, "documents"), "doc_id", "text")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "body"))), lambda s: s["body"]), "")
    title = F.max(F.when(F.col("chunk") == 0, F.col("body")))
    return c.groupBy("doc_id").agg(F.md5(F.regexp_replace(whole, _SPACE, "")).alias("body_md5"), (F.coalesce(F.max(F.when(F.col("chunk") > 0, F.octet_length("body"))), F.lit(0)) <= 2000).alias("within_limit"), F.md5(title).alias("title_md5"))


@query(R._SPARSE.replace("@idf@", "").replace("SELECT query_id::BIGINT AS query_id, id, 1 - sum(wt.weight * q.weight) AS d FROM wt JOIN q ON wt.dim = q.dim JOIN f ON f.dim = q.dim GROUP BY query_id, id",
    "SELECT p.query_id, p.id, 1 - coalesce(s, 0) AS d FROM (SELECT DISTINCT q.query_id, d.doc_id AS id FROM q, documents d) p LEFT JOIN (SELECT query_id, id, sum(wt.weight * q.weight) AS s FROM wt JOIN q ON wt.dim = q.dim GROUP BY query_id, id) m ON p.query_id = m.query_id AND p.id = m.id"))
def sparse_knn_log(spark, sf):
    """Sparse search without an index: every record takes part, at distance 1 without a common dimension."""
    docs = table(spark, sf, "documents")
    asked = R._texts(bm25_weights(docs.filter("doc_id % 20 = 0"), "doc_id", "text", stem=False))
    return R._found(sparse_knn(bm25_weights(docs, "doc_id", "text", stem=False), asked, 15, docs.select(F.col("doc_id").alias("id"))))


@query("SELECT id, label, true AS known FROM (SELECT vec_id AS id, label FROM embeddings)")
def segment_rebuild(spark, sf):
    """A segment read as a log, shard by shard, and folded into a new one."""
    c = _folded(spark, sf)
    segment = c.catalog.read_segment(c.version)
    parts = [oplog.materialize(oplog.segment_as_log(segment, 4, n).drop("shard"), segment.limit(0)) for n in range(4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("id").cast("long").alias("id"), F.col("metadata")["label"].cast("int").alias("label"), (F.col("mat_op") == "add_new").alias("known"))
