"""Queries of the retrieval operators, over the whole test tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import incremental
from ..functions import metadata as M
from ..functions import text as T
from ..operators import oplog
from ..operators.cells import build_cells, search_cells
from ..operators.knn import knn, merge
from ..operators.rank import Knn, Val, rank_rows, rrf
from ..operators.sparse import bm25_weights, idf, rescale, sparse_knn
from ..operators.where import FlatBinding, K, Key, MapBinding, compile_where, parse_where, parse_where_document
from ..plans import search as P
from ..plans.chunks import checkpointed, shared_folder
from ..plans.skew import lookup
from ..sources.tables import table
from ..streaming.fold import fold_stream
from . import records

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Cells of 16 that the approximate searches probe; the README has the recall measured with them.
PROBES = 12


def query(sql: str | None = None):
    """Register a query, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Predicates: documents as a flat collection. Null cells are missing keys.
_DOC_KEYS = {"lang": "lang", "source": "source", "n_chars": "n_chars", "collection": "collection_id", "uri": "uri"}


def _docs(spark: SparkSession, sf: str, where=None, where_document=None) -> DataFrame:
    docs = table(spark, sf, "documents")
    binding = FlatBinding(docs, _DOC_KEYS, document="text", id="doc_id")
    for w in (parse_where(where), parse_where_document(where_document)):
        docs = docs if w is None else docs.filter(compile_where(w, binding))
    return docs


@query("SELECT doc_id, lang FROM documents WHERE lang = 'de'")
def filter_eq(spark, sf):
    return _docs(spark, sf, {"lang": "de"}).select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE lang IS DISTINCT FROM 'en'")
def filter_ne(spark, sf):
    return _docs(spark, sf, {"lang": {"$ne": "en"}}).select("doc_id")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars > 500 AND n_chars <= 1500.5")
def filter_range(spark, sf):
    return _docs(spark, sf, (Key("n_chars") > 500) & (Key("n_chars") <= 1500.5)).select("doc_id", "n_chars")


@query("SELECT doc_id FROM documents WHERE lang IN ('fr', 'es', 'pl')")
def filter_in(spark, sf):
    return _docs(spark, sf, {"lang": {"$in": ["fr", "es", "pl"]}}).select("doc_id")


@query("SELECT doc_id FROM documents WHERE coalesce(source NOT IN ('docs', 'chat'), true)")
def filter_nin(spark, sf):
    return _docs(spark, sf, {"source": {"$nin": ["docs", "chat"]}}).select("doc_id")


@query("SELECT doc_id FROM documents WHERE coalesce(lang = 'en', false) AND (coalesce(n_chars >= 800, false) OR NOT coalesce(source = 'issues', false))")
def filter_and_or(spark, sf):
    return _docs(spark, sf, {"$and": [{"lang": "en"}, {"$or": [{"n_chars": {"$gte": 800}}, {"source": {"$ne": "issues"}}]}]}).select("doc_id")


@query("SELECT doc_id FROM documents WHERE coalesce(n_chars = 2, false) OR coalesce(n_chars < 3, false)")
def filter_type_mismatch(spark, sf):
    """A text never equals a number: those leaves are false, not errors."""
    return _docs(spark, sf, {"$or": [{"n_chars": "2"}, {"lang": 5}, {"n_chars": 2}, {"n_chars": {"$lt": 3}}]}).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(text, 'shard')")
def doc_contains(spark, sf):
    return _docs(spark, sf, where_document={"$contains": "shard"}).select("doc_id")


@query("SELECT doc_id FROM documents WHERE NOT coalesce(contains(text, 'the '), false)")
def doc_not_contains(spark, sf):
    return _docs(spark, sf, where_document={"$not_contains": "the "}).select("doc_id")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '[Tt]he \w+ (shard|collection|index)')")
def doc_regex(spark, sf):
    return _docs(spark, sf, where_document={"$regex": r"[Tt]he \w+ (shard|collection|index)"}).select("doc_id")


@query(r"SELECT doc_id FROM documents WHERE NOT coalesce(regexp_matches(text, '[0-9]{4}'), false)")
def doc_not_regex(spark, sf):
    return _docs(spark, sf, where_document={"$not_regex": "[0-9]{4}"}).select("doc_id")


@query("SELECT doc_id FROM documents")
def doc_regex_empty(spark, sf):
    """A pattern that can match nothing at all holds for every row, even without a text."""
    return _docs(spark, sf, where_document={"$regex": "x*"}).select("doc_id")


@query("SELECT doc_id, text FROM documents WHERE doc_id IN (1001, 1017, 1500, 1999)")
def get_ids(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.filter(compile_where(Key("#id").is_in([1001, 1017, 1500, 1999, -5]), FlatBinding(docs, _DOC_KEYS, "text", "doc_id"))).select("doc_id", "text")


@query("SELECT doc_id, lang FROM documents WHERE coalesce(n_chars > 1000, false) ORDER BY doc_id LIMIT 25 OFFSET 10")
def get_limit_offset(spark, sf):
    return P.paged(_docs(spark, sf, {"n_chars": {"$gt": 1000}}).select("doc_id", "lang"), P.Limit(10, 25), F.col("doc_id").asc())


@query("SELECT count(*) AS n FROM documents WHERE lang IN ('en', 'EN')")
def count_where(spark, sf):
    return _docs(spark, sf, {"lang": {"$in": ["en", "EN"]}}).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 10")
def peek(spark, sf):
    return P.paged(table(spark, sf, "documents").select("doc_id", "text"), P.Limit(0, 10), F.col("doc_id").asc())


@query("SELECT search_id, agg_op FROM searches WHERE list_contains(group_keys, 'category')")
def array_contains(spark, sf):
    s = table(spark, sf, "searches")
    return s.filter(compile_where(Key("group_keys").contains("category"), FlatBinding(s, {"group_keys": "group_keys"}))).select("search_id", "agg_op")


@query("SELECT search_id FROM searches WHERE NOT coalesce(list_contains(group_keys, 'category'), false)")
def array_not_contains(spark, sf):
    s = table(spark, sf, "searches")
    return s.filter(compile_where(Key("group_keys").not_contains("category"), FlatBinding(s, {"group_keys": "group_keys"}))).select("search_id")


@query("""SELECT collection_id, record_id FROM segment_records WHERE coalesce((metadata->>'prio')::DOUBLE >= 4, false)
    AND NOT coalesce(metadata->>'cat' IN ('beta', 'zeta'), false) AND NOT coalesce((metadata->>'is_even')::BOOLEAN, false)""")
def filter_dynamic(spark, sf):
    """Predicates over maps of dynamically typed values."""
    r = table(spark, sf, "segment_records").withColumn("metadata", M.from_json(F.col("metadata")))
    w = (Key("prio") >= 4) & Key("cat").not_in(["beta", "zeta"]) & (Key("is_even") != True)  # noqa: E712
    return r.filter(compile_where(w, MapBinding())).select("collection_id", "record_id")


# Vectors: embeddings as a collection, some of its rows as query vectors.
def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _asked(corpus: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 20."""
    return corpus.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))


def _found(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


_L2 = "list_sum(list_transform(range(1, 65), lambda i: (q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE) ** 2))"
_DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}.embedding[i]::DOUBLE * {b}.embedding[i]::DOUBLE))"
_METRIC = {"l2": _L2, "ip": f"1 - {_DOT.format(a='q', b='e')}", "cosine": f"1 - {_DOT.format(a='q', b='e')} / (sqrt({_DOT.format(a='q', b='q')}) * sqrt({_DOT.format(a='e', b='e')}))"}


def _knn_sql(space: str, k: int = 5, where: str = "true") -> str:
    return f"""SELECT query_id, id, round(d, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS rank
      FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_METRIC[space]} AS d FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND {where})) WHERE rank <= {k}"""


@query(_knn_sql("l2"))
def knn_l2(spark, sf):
    c = _corpus(spark, sf)
    return _found(knn(c, _asked(c), 5, "l2"))


@query(_knn_sql("cosine"))
def knn_cosine(spark, sf):
    c = _corpus(spark, sf)
    return _found(knn(c, _asked(c), 5, "cosine"))


@query(_knn_sql("ip"))
def knn_ip(spark, sf):
    c = _corpus(spark, sf)
    return _found(knn(c, _asked(c), 5, "ip"))


@query(_knn_sql("l2", 5, "e.label IN (1, 3) AND e.label <> 3"))
def knn_filtered(spark, sf):
    c = _corpus(spark, sf)
    hit = c.filter(compile_where(Key("label").is_in([1, 3]) & (Key("label") != 3), FlatBinding(c, {"label": "label"})))
    return _found(knn(hit, _asked(c), 5, "l2"))


@query(_knn_sql("cosine", 3))
def knn_batch(spark, sf):
    """Every twentieth row as a query against all rows."""
    c = _corpus(spark, sf)
    return _found(knn(c, _asked(c), 3, "cosine"))


@query(_knn_sql("l2", 8))
def knn_merge_shards(spark, sf):
    c = _corpus(spark, sf).withColumn("shard", oplog.shard_of(F.col("id").cast("string"), 3))
    return _found(merge([knn(c.filter(F.col("shard") == n), _asked(c), 8, "l2") for n in range(3)], 8))


@query(_knn_sql("l2", 5))
def ivf_knn_all_cells(spark, sf):
    """A search of all cells is exact."""
    c = _corpus(spark, sf)
    return _found(search_cells(build_cells(c, 16), _asked(c), 5, 16))


@query()
def ivf_knn(spark, sf):
    c = _corpus(spark, sf)
    return _found(search_cells(build_cells(c, 16), _asked(c), 5, PROBES))


@query()
def quantized_knn(spark, sf):
    c = _corpus(spark, sf)
    return _found(search_cells(build_cells(c, 16), _asked(c), 5, PROBES, rerank=200))


# Rank expressions over two leaves of the embeddings.
def _ranked(spark: SparkSession, sf: str, expr) -> DataFrame:
    c = _corpus(spark, sf)

    def leaf(x: Knn) -> DataFrame:
        q = c.filter(F.col("id") == x.query).select(F.lit(0).cast("long").alias("query_id"), F.col("embedding").alias("query"))
        return knn(c, q, x.limit, "l2").select("id", "distance", "rank")

    return rank_rows(expr, leaf, c.select("id", F.lit(0.0).alias("score"))).select("id", F.round("score", 6).alias("score"))


def _leaf_sql(name: str, q: int, k: int) -> str:
    return f"{name} AS (SELECT id, d, r FROM (SELECT e.vec_id AS id, {_L2} AS d, row_number() OVER (ORDER BY round({_L2}, 9), e.vec_id) AS r FROM embeddings q, embeddings e WHERE q.vec_id = {q}) WHERE r <= {k})"


_TWO = f"WITH {_leaf_sql('a', 0, 40)}, {_leaf_sql('b', 7, 60)}"
_A, _B = Knn(0, limit=40), Knn(7, limit=60)


@query(f"{_TWO} SELECT coalesce(a.id, b.id) AS id, round(0.7 * coalesce(a.d, 50) + 0.3 * coalesce(b.d, 80), 6) AS score FROM a FULL JOIN b ON a.id = b.id")
def rank_sum_default(spark, sf):
    return _ranked(spark, sf, Knn(0, limit=40, default=50.0) * 0.7 + Knn(7, limit=60, default=80.0) * 0.3)


@query(f"{_TWO} SELECT a.id, round(a.d * b.d - a.d / 2, 6) AS score FROM a JOIN b ON a.id = b.id")
def rank_intersection(spark, sf):
    return _ranked(spark, sf, _A * _B - _A / 2)


@query(f"{_TWO} SELECT a.id, round(greatest(a.d, coalesce(b.d, 10)) + least(a.d, 30), 6) AS score FROM a LEFT JOIN b ON a.id = b.id")
def rank_max_min(spark, sf):
    return _ranked(spark, sf, _A.max(Knn(7, limit=60, default=10.0)) + _A.min(30))


@query(f"{_TWO} SELECT id, CASE WHEN d = 0 THEN 'Infinity'::DOUBLE ELSE round(abs(ln(CASE WHEN d > 0 THEN d ELSE 1 END) - exp(-d / 100)), 6) END AS score FROM a")
def rank_unary(spark, sf):
    return _ranked(spark, sf, abs(_A.log() - (_A * -0.01).exp()))


@query(f"{_TWO} SELECT coalesce(a.id, b.id) AS id, round(-(0.6 / (60 + coalesce(a.r - 1, 1000)) + 0.4 / (60 + coalesce(b.r - 1, 1000))), 6) AS score FROM a FULL JOIN b ON a.id = b.id")
def rrf_hybrid(spark, sf):
    return _ranked(spark, sf, rrf([Knn(0, limit=40, default=1000.0, return_rank=True), Knn(7, limit=60, default=1000.0, return_rank=True)], [3.0, 2.0], normalize=True))


# Composed searches over a record frame.
def _records(spark: SparkSession, sf: str) -> DataFrame:
    meta = F.create_map(F.lit("label"), M_INT(F.col("label")), F.lit("parity"), M_STR(F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd")))
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("offset_id"), F.concat(F.lit("item "), F.col("vec_id")).alias("document"), "embedding", meta.alias("metadata"))


def _meta(t: int, name: str, c):
    kinds = {"b": "boolean", "i": "bigint", "f": "double", "s": "string", "ba": "array<boolean>", "ia": "array<bigint>", "fa": "array<double>", "sa": "array<string>", "sv": M.SPARSE}
    return F.struct(F.lit(t).cast("tinyint").alias("t"), *[(c if n == name else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


def M_INT(c):
    """A META value of an integer column."""
    return _meta(M.INT, "i", c)


def M_STR(c):
    """A META value of a text column."""
    return _meta(M.STR, "s", c)


@query("SELECT vec_id::VARCHAR AS id, (row_number() OVER (ORDER BY vec_id) - 1)::DOUBLE AS score, row_number() OVER (ORDER BY vec_id) AS rank FROM (SELECT vec_id FROM embeddings WHERE label = 2 ORDER BY vec_id LIMIT 12 OFFSET 3)")
def search_no_rank(spark, sf):
    return P.run_search(_records(spark, sf), P.Search().where(Key("label") == 2).limit(12, 3).select(K.SCORE))


def _vector(spark: SparkSession, sf: str, id: int) -> list[float]:
    return table(spark, sf, "embeddings").filter(F.col("vec_id") == id).first()["embedding"]


_ONE = f"WITH {_leaf_sql('a', 42, 100)}, m AS (SELECT a.id, a.d, e.label FROM a JOIN embeddings e ON a.id = e.vec_id)"


@query(f"""{_ONE}, g AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, id) AS k FROM m)
    SELECT id::VARCHAR AS id, round(d, 6) AS score, row_number() OVER (ORDER BY d, id) AS rank FROM g WHERE k <= 3 ORDER BY d, id LIMIT 20""")
def groupby_min_k(spark, sf):
    s = P.Search().rank(Knn(_vector(spark, sf, 42), limit=100)).group_by(P.GroupBy(("label",), P.MinK("#score", 3))).limit(20).select(K.SCORE)
    return P.run_search(_records(spark, sf), s).withColumn("score", F.round("score", 6))


@query(f"""{_ONE}, g AS (SELECT *, row_number() OVER (PARTITION BY id % 2 ORDER BY label DESC, d, id) AS k FROM m)
    SELECT id::VARCHAR AS id, round(d, 6) AS score, row_number() OVER (ORDER BY d, id) AS rank FROM g WHERE k <= 7""")
def groupby_max_k(spark, sf):
    s = P.Search.from_dict({"rank": {"$knn": {"query": _vector(spark, sf, 42), "limit": 100}}, "group_by": {"keys": ["parity"], "aggregate": {"$max_k": {"keys": ["label"], "k": 7}}}, "select": {"keys": ["#score"]}})
    return P.run_search(_records(spark, sf), s).withColumn("score", F.round("score", 6))


@query("SELECT vec_id::VARCHAR AS id, 'item ' || vec_id AS document, label::BIGINT AS label, rank FROM (SELECT *, row_number() OVER (ORDER BY vec_id) AS rank FROM embeddings) WHERE rank <= 30")
def select_fields(spark, sf):
    out = P.run_search(_records(spark, sf), P.Search().limit(30).select("label", K.DOCUMENT))
    return out.select("id", "document", F.col("metadata")["label"]["i"].alias("label"), "rank")


@query(f"SELECT query_id, rank, id::VARCHAR AS id, distance FROM ({_knn_sql('cosine', 4, 'e.label <> 3')})")
def query_records(spark, sf):
    """The plan of a query with a filter, with the results' bodies joined last."""
    found = P.run_knn(_records(spark, sf), _asked(_corpus(spark, sf)), 4, "cosine", where={"label": {"$ne": 3}}, include=("distances",))
    return found.withColumn("distance", F.round("distance", 6))


# Text.
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOP_WORDS)
_TOKENS = rf"toks AS (SELECT doc_id AS id, list_filter(list_transform(regexp_split_to_array(text, '[^\pL\pN_]+'), lambda w: lower(w)), lambda w: w <> '' AND length(w) <= 40 AND w NOT IN ({_STOP})) AS t FROM documents WHERE text IS NOT NULL)"


_TF = f"WITH {_TOKENS}, tf AS (SELECT id, w AS dim, count(*) AS n, any_value(len) AS len FROM (SELECT id, unnest(t) AS w, len(t) AS len FROM toks) GROUP BY id, w), wt AS (SELECT id, dim, n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len / 256.0)) AS weight FROM tf)"


@query(f"{_TF} SELECT id, dim, round(weight, 6) AS weight FROM wt")
def bm25_tf(spark, sf):
    return bm25_weights(table(spark, sf, "documents"), "doc_id", "text", stem=False).withColumn("weight", F.round("weight", 6))


@query(f"{_TF} SELECT dim, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM wt GROUP BY dim")
def idf_df(spark, sf):
    docs = table(spark, sf, "documents")
    return idf(bm25_weights(table(spark, sf, "documents"), "doc_id", "text", stem=False), docs.count()).withColumn("idf", F.round("idf", 6))


# Every twentieth document's text as a query against all documents.
_SPARSE = f"""{_TF}, q AS (SELECT id AS query_id, dim, weight FROM wt WHERE id % 20 = 0),
    f AS (SELECT dim, count(*) AS df FROM wt GROUP BY dim),
    s AS (SELECT query_id::BIGINT AS query_id, id, 1 - sum(wt.weight * q.weight@idf@) AS d FROM wt JOIN q ON wt.dim = q.dim JOIN f ON f.dim = q.dim GROUP BY query_id, id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS rank FROM s)
    SELECT query_id, id, round(d, 6) AS distance, rank FROM r WHERE rank <= 15"""


def _texts(weights: DataFrame) -> DataFrame:
    return weights.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "dim", "weight")


@query(_SPARSE.replace("@idf@", ""))
def sparse_knn_overlap(spark, sf):
    docs = table(spark, sf, "documents")
    return _found(sparse_knn(bm25_weights(docs, "doc_id", "text", stem=False), _texts(bm25_weights(docs.filter("doc_id % 20 = 0"), "doc_id", "text", stem=False)), 15))


@query(_SPARSE.replace("@idf@", " * ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5))"))
def sparse_knn_idf(spark, sf):
    size = table(spark, sf, "documents").count()
    w = checkpointed(bm25_weights(table(spark, sf, "documents"), "doc_id", "text", stem=False))  # the inverted index
    return _found(sparse_knn(w, rescale(_texts(w), idf(w, size), size), 15))


@query()
def bm25_stemmed(spark, sf):
    return bm25_weights(table(spark, sf, "documents"), "doc_id", "text").withColumn("weight", F.round("weight", 6))


@query("SELECT doc_id, coalesce(len(list_distinct(list_transform(range(1, length(text) - 1), lambda i: substring(text, i, 3)))), 0) AS n FROM documents")
def doc_trigrams(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.array_size(T.trigrams(F.col("text"))), F.lit(0)).cast("long").alias("n"))


@query()
def markdown_chunks(spark, sf):
    return T.chunks(table(spark, sf, "documents"), "doc_id", "text")


# Log: events as operations on users; an error deletes the user, all else upserts.
def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    meta = F.to_json(F.struct(F.col("event_type").alias("kind"), F.round("value", 2).alias("value")))
    return e.select(F.col("user_id").cast("string").alias("id"), (F.col("event_id") + 1).alias("log_offset"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.col("event_type").alias("document"), F.lit(None).cast("array<float>").alias("embedding"), meta.alias("metadata"))


def _no_segment(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id string, offset_id long, document string, embedding array<float>, metadata string")


_LAST = "last AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events{where})"
_NEW = """seen AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
    new AS (SELECT user_id, row_number() OVER (ORDER BY event_id) AS n FROM seen WHERE event_type <> 'error' AND (before IS NULL OR before = 'error')),
    place AS (SELECT user_id, max(n) AS n FROM new GROUP BY user_id)"""


@query(f"WITH {_LAST.format(where='')}, {_NEW} SELECT l.user_id::VARCHAR AS id, p.n AS offset_id, 'add_new' AS mat_op, event_id + 1 AS last_log_offset, event_type AS document FROM last l JOIN place p ON l.user_id = p.user_id WHERE k = 1 AND event_type <> 'error'")
def oplog_fold(spark, sf):
    return oplog.materialize(_events(spark, sf), _no_segment(spark)).select("id", "offset_id", "mat_op", "last_log_offset", "document")


@query(f"WITH {_LAST.format(where='')} SELECT count(*) AS n FROM last WHERE k = 1 AND event_type <> 'error'")
def oplog_count(spark, sf):
    return oplog.count_records(_events(spark, sf), _no_segment(spark))


@query(f"WITH {_LAST.format(where=' WHERE event_id < 250')} SELECT user_id::VARCHAR AS id, event_type AS document FROM last WHERE k = 1 AND event_type <> 'error'")
def fold_bounded(spark, sf):
    log = oplog.read_level(_events(spark, sf), oplog.BOUNDED_WAL)
    return oplog.current_records(log, _no_segment(spark)).select("id", "document")


@query(f"WITH {_LAST.format(where='')} SELECT id::VARCHAR AS id, (SELECT max(event_id) + 1 FROM events) + row_number() OVER (ORDER BY id::VARCHAR) AS log_offset, 'delete' AS op FROM (SELECT user_id AS id FROM last WHERE k = 1 AND event_type IN ('click', 'view'))")
def delete_where(spark, sf):
    """Deletes by filter: the fold, the filter, and the log rows that follow."""
    log = _events(spark, sf)
    gone = P.run_get(oplog.current_records(log, _no_segment(spark)), where={"kind": {"$in": ["click", "view"]}}, include=())
    top = log.agg(F.max("log_offset").alias("m")).first()["m"]
    return oplog.delete_operations(gone, top + 1).select("id", "log_offset", "op")


@query("SELECT count(CASE WHEN event_id < 300 THEN 1 END) AS indexed_ops, count(CASE WHEN event_id >= 300 THEN 1 END) AS unindexed_ops, round(count(CASE WHEN event_id < 300 THEN 1 END) / count(*), 6) AS progress FROM events")
def indexing_status(spark, sf):
    return oplog.indexing_status(_events(spark, sf), 300).withColumn("progress", F.round("progress", 6))


@query("SELECT user_id::VARCHAR AS id, count(*) AS n FROM events GROUP BY user_id")
def partition_log(spark, sf):
    """After partitioning the log by record no further shuffle is needed to count a record's operations."""
    return oplog.partition_log(_events(spark, sf), 8).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def _changes(spark: SparkSession, sf: str, split: int = 400) -> tuple[DataFrame, DataFrame]:
    """Changes of two compactions: of the first ``split`` events, and of the others to the state after these."""
    log, none = _events(spark, sf), _no_segment(spark)
    first = checkpointed(oplog.materialize(oplog.fetch_log(log, upto=split), none))
    text = F.to_json(F.transform_values("metadata", lambda _, v: F.parse_json(v)))
    segment = first.select("id", "offset_id", "document", "embedding", text.alias("metadata"))
    return incremental.changes(first, none), incremental.changes(oplog.materialize(oplog.fetch_log(log, split), segment), segment)


_LIVE = f"WITH {_LAST.format(where='')}, live AS (SELECT * FROM last WHERE k = 1 AND event_type <> 'error')"


@query(f"""{_LIVE} SELECT 'kind' AS key, 'str' AS type, event_type AS value, count(*) AS count FROM live GROUP BY event_type
    UNION ALL SELECT 'value', 'float', round(value, 2)::VARCHAR, count(*) FROM live WHERE value IS NOT NULL GROUP BY round(value, 2)
    UNION ALL SELECT 'summary', 'str', 'total_count', count(*) FROM live""")
def stats_counts(spark, sf):
    """Statistics of the live records, in two incremental steps."""
    first, second = _changes(spark, sf)
    return incremental.statistics(second, incremental.statistics(first)).select("key", "type", "value", "count")


@query(f"{_LIVE} SELECT count(*) AS total_count FROM live")
def record_counter(spark, sf):
    first, second = _changes(spark, sf)
    return incremental.record_counter(second, incremental.record_counter(first))


@query("SELECT user_id || '::v' || v AS id, user_id::VARCHAR AS original_id, v AS version, event_type = 'error' AS is_delete, event_type AS document FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS v FROM events)")
def revision_history(spark, sf):
    return incremental.revision_history(_events(spark, sf)).select("id", "original_id", "version", "is_delete", "document")


@query(f"""WITH old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_id < 400) WHERE k = 1 AND event_type <> 'error'),
    {_LAST.format(where=' WHERE event_id >= 400')}
    SELECT n.user_id::VARCHAR AS id, o.user_id IS NULL AS is_new,
      CASE WHEN o.event_type <> n.event_type THEN o.event_type || ' to ' || n.event_type END AS kind_changed,
      CASE WHEN round(o.value, 2) <> round(n.value, 2) THEN round(100 * o.value)::BIGINT || ' to ' || round(100 * n.value)::BIGINT END AS cents_changed,
      CASE WHEN o.user_id IS NULL OR o.value IS NULL THEN round(100 * n.value)::BIGINT END AS cents_inserted,
      CASE WHEN n.value IS NULL THEN round(100 * o.value)::BIGINT END AS cents_deleted
    FROM last n LEFT JOIN old o ON n.user_id = o.user_id WHERE n.k = 1 AND n.event_type <> 'error'""")
def metadata_delta(spark, sf):
    """What a compaction changes in the metadata: values put in, taken out, and replaced."""
    d = _changes(spark, sf)[1].filter("mat_op <> 'delete_existing'").withColumn("d", M.delta(F.col("old"), F.col("new")))
    cents = lambda v: F.round(100 * v["f"]).cast("long")
    kind, value = (F.try_element_at("d.updates", F.lit(k)) for k in ("kind", "value"))
    return d.select(
        "id",
        (F.col("mat_op") == "add_new").alias("is_new"),
        F.concat(kind["old"]["s"], F.lit(" to "), kind["new"]["s"]).alias("kind_changed"),
        F.concat(cents(value["old"]), F.lit(" to "), cents(value["new"])).alias("cents_changed"),
        cents(F.try_element_at("d.inserts", F.lit("value"))).alias("cents_inserted"),
        cents(F.try_element_at("d.deletes", F.lit("value"))).alias("cents_deleted"),
    )


# The log of all shards with one order, in which the operations of a shard come by their offsets.
_SHARD = "shard AS (SELECT collection_id, shard_index, row_number() OVER (ORDER BY collection_id, shard_index) AS no FROM (SELECT DISTINCT collection_id, shard_index FROM oplog))"
_WIDE = 1 << 32


def _all_shards(spark: SparkSession, sf: str) -> DataFrame:
    """The operations of oplog with ids of their own across collections and offsets of their own across shards."""
    log = table(spark, sf, "oplog").select("collection_id", "shard_index", "record_id", "log_offset", "op", F.col("doc_text").alias("document"), "embedding", "metadata").filter("record_id is not null")
    shards = table(spark, sf, "oplog").select("collection_id", "shard_index").distinct()  # a catalogue's shards, not its rows
    number = shards.withColumn("_no", F.row_number().over(Window.orderBy("collection_id", "shard_index")))
    placed = log.join(F.broadcast(number), ["collection_id", "shard_index"])
    return placed.withColumn("id", F.concat("collection_id", F.lit("/"), "record_id")).withColumn("_seq", F.col("_no") * _WIDE + F.col("log_offset"))


@query(f"""WITH {records.ROWS}, {_SHARD},
    ours AS (SELECT DISTINCT o.collection_id, o.record_id, no FROM oplog o JOIN shard s ON o.collection_id = s.collection_id AND o.shard_index = s.shard_index WHERE o.record_id IS NOT NULL),
    base AS (SELECT collection_id, record_id, offset_id FROM segment_records), top AS (SELECT coalesce(max(offset_id), 0) AS top FROM base),
    gone AS (SELECT DISTINCT collection_id, record_id FROM bounded WHERE op = 'delete'),
    live AS (SELECT collection_id, record_id, max(seq) AS last FROM eff GROUP BY ALL),
    seen AS (SELECT b.collection_id, b.record_id, seq, op, no, lag(op = 'delete') OVER (PARTITION BY b.collection_id, b.record_id ORDER BY seq) AS before
      FROM (SELECT DISTINCT collection_id, record_id, seq, op FROM bounded WHERE op <> 'update') b JOIN ours o ON b.collection_id = o.collection_id AND b.record_id = o.record_id),
    new AS (SELECT s.collection_id, s.record_id, row_number() OVER (ORDER BY no, seq) AS n FROM seen s LEFT JOIN base b ON s.collection_id = b.collection_id AND s.record_id = b.record_id
      WHERE op <> 'delete' AND coalesce(before, true) AND b.offset_id IS NULL),
    place AS (SELECT collection_id, record_id, max(n) AS n FROM new GROUP BY ALL)
    SELECT l.collection_id || '/' || l.record_id AS id, coalesce(b.offset_id, top + n) AS offset_id, last AS last_log_offset,
      CASE WHEN b.offset_id IS NULL THEN 'add_new' WHEN g.record_id IS NOT NULL THEN 'overwrite_existing' ELSE 'update_existing' END AS mat_op
    FROM live l CROSS JOIN top LEFT JOIN base b ON l.collection_id = b.collection_id AND l.record_id = b.record_id LEFT JOIN gone g ON l.collection_id = g.collection_id AND l.record_id = g.record_id
      LEFT JOIN place p ON l.collection_id = p.collection_id AND l.record_id = p.record_id WHERE b.offset_id IS NULL OR g.record_id IS NOT NULL OR last > 0
    UNION ALL SELECT b.collection_id || '/' || b.record_id, b.offset_id, NULL, 'delete_existing'
    FROM base b JOIN gone g ON b.collection_id = g.collection_id AND b.record_id = g.record_id LEFT JOIN live l ON b.collection_id = l.collection_id AND b.record_id = l.record_id WHERE l.record_id IS NULL""")
def materialize_segment(spark, sf):
    """The log of all shards, within the bounds of their scans, over the segment: all four kinds of change, with offset ids."""
    scans = table(spark, sf, "scans").groupBy("collection_id", "shard_index").agg(F.max("log_position").alias("_from"), F.max("log_upper_bound").alias("_to"))
    log = lookup(_all_shards(spark, sf), scans, ["collection_id", "shard_index"], salt=F.col("_seq"))
    log = log.filter((F.col("log_offset") > F.coalesce("_from", F.lit(0))) & ((F.coalesce("_to", F.lit(0)) == 0) | (F.col("log_offset") <= F.col("_to"))))
    segment = table(spark, sf, "segment_records").select(F.concat("collection_id", F.lit("/"), "record_id").alias("id"), "offset_id", F.col("doc_text").alias("document"), "embedding", "metadata")
    done = oplog.materialize(log.select("id", F.col("_seq").alias("log_offset"), "op", "document", "embedding", "metadata"), segment)
    return done.select("id", "offset_id", (F.col("last_log_offset") % _WIDE).alias("last_log_offset"), "mat_op")


@query(f"""WITH {records.ROWS.replace("AND o.log_offset > coalesce(s.log_position, 0)", "").replace("AND (coalesce(s.log_upper_bound, 0) = 0 OR o.log_offset <= s.log_upper_bound)", "").replace(
        "UNION ALL SELECT collection_id, record_id, 0, 'base', doc_text, embedding, metadata FROM segment_records", "")}
    SELECT collection_id || '/' || record_id AS id, max(seq) AS last_log_offset, arg_max(doc_text, seq) FILTER (doc_text IS NOT NULL) AS document FROM eff GROUP BY ALL""")
def stream_fold(spark, sf):
    """The stateful streaming fold over the whole log in several micro-batches, whose operations are late and repeated."""
    log = _all_shards(spark, sf).select("id", "log_offset", "op", "document", "embedding", "metadata")
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    log.repartition(4, "log_offset", "op").write.parquet(f"{out}/log")
    ops = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/log")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/found/batch={epoch}")

    q = fold_stream(ops).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.read.parquet(f"{out}/found").groupBy("id").agg(F.max_by(F.struct("live", "last_log_offset", "document"), "batch").alias("s"))
    return last.filter("s.live").select("id", "s.last_log_offset", "s.document")
