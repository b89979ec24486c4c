import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest

from lodestrata import maintenance
from lodestrata.collection import Collection
from lodestrata.functions import incremental
from lodestrata.functions import metadata as M
from lodestrata.operators import oplog
from lodestrata.operators.rank import Knn
from lodestrata.operators.where import K
from lodestrata.plans.search import Search
from lodestrata.sources.catalog import Catalog, CatalogError, Conflict
from lodestrata.sources.storage import Storage


@pytest.fixture()
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "cat"))


def make(catalog, name="things", **config):
    return Collection(catalog, catalog.create_collection(name, config=config))


def docs(df):
    return {r["id"]: r["document"] for r in df.collect()}


def test_writes_reads_and_compaction_agree(catalog):
    c = make(catalog)
    c.add(["a", "b", "c"], [[1, 0], [0, 1], [1, 1]], [{"n": 1}, {"n": 2.5, "s": "x"}, None], ["da", "db", "dc"])
    c.add(["a"], [[9, 9]], documents=["ignored"])
    c.update(["b", "zz"], metadatas=[{"s": None, "t": True}, {"n": 1}])
    c.upsert(["d"], [[2, 2]], documents=["dd"])
    assert c.delete(ids=["c", "nope"]) == 1
    want = {"a": "da", "b": "db", "d": "dd"}

    def check():
        assert docs(c.get()) == want and c.count() == 3 and c.count(where={"n": {"$gt": 1}}) == 1
        meta = {k: M.decode(v) for k, v in c.get(ids=["b"]).first()["metadata"].items()}
        assert meta == {"n": 2.5, "t": True}
        assert [r["id"] for r in c.query([[1, 0]], n_results=2).orderBy("rank").collect()] == ["a", "b"]
        assert [r["id"] for r in c.peek(2).collect()] == ["a", "b"]
        assert [r["id"] for r in c.search(Search().rank(Knn([0.0, 1.0], limit=5)).limit(1).select(K.SCORE)).collect()] == ["b"]

    check()
    assert c.count(level="index_only") == 0 and c.indexing_status().first()["unindexed_ops"] == 8
    c.compact()
    check()
    assert c.count(level="index_only") == 3 and c.indexing_status().first()["progress"] == 1.0
    assert c.delete(where={"n": 1}) == 1
    c.add(["a"], [[5, 5]], documents=["again"])
    got = c.records().filter("id = 'a'").first()
    assert got["offset_id"] == 1 and got["document"] == "again" and got["metadata"] == {}
    c.compact()
    assert docs(c.get()) == {"a": "again", "b": "db", "d": "dd"}


def test_bad_calls(catalog):
    c = make(catalog)
    for bad in (lambda: c.add([], []), lambda: c.add(["x", "x"], [[1], [1]]), lambda: c.add([""], [[1]]), lambda: c.add(["x"]), lambda: c.add(["x"], [[1], [2]]), lambda: c.delete(), lambda: c.delete(ids=["a"], limit=1), lambda: c.query(), lambda: c.query(query_texts=["x"]), lambda: c.query([[1.0]], n_results=0)):
        with pytest.raises(ValueError):
            bad()
    c.add(["x"], [[1, 2]])
    with pytest.raises(ValueError):
        c.upsert(["y"], [[1, 2, 3]])


def test_text_is_embedded_and_frames_are_loaded(spark, catalog):
    c = make(catalog, embedding_function={"name": "hashing", "config": {"dim": 32}})
    c.add(["a", "b"], documents=["red apple", "blue sky"])
    assert c.query(query_texts=["apple red"], n_results=1).first()["id"] == "a"
    n = c.write_frame(spark.createDataFrame([("c", "green grass", None, '{"k": 1}'), (None, "x", None, None)], "id string, document string, embedding array<float>, metadata string"))
    assert n == 1 and c.count() == 3 and c.search({"filter": {"k": 1}, "select": {"keys": ["k"]}}).first()["id"] == "c"


def test_catalog(catalog):
    for bad in ("ab", "-ab", "a..b", "1.2.3.4", "x" * 513, "a b c"):
        with pytest.raises(CatalogError):
            catalog.create_collection(bad)
    v = catalog.create_collection("one", {"k": 1})
    assert catalog.create_collection("one", get_or_create=True).id == v.id
    with pytest.raises(CatalogError):
        catalog.create_collection("one")
    catalog.create_collection("two")
    assert [x.name for x in catalog.list_collections()] == ["one", "two"] and [x.name for x in catalog.list_collections(1, 1)] == ["two"] and catalog.count_collections() == 2
    v = catalog.modify_collection(v, "uno", {"k": 2})
    assert catalog.get_collection("uno").metadata == {"k": 2}
    with pytest.raises(CatalogError):
        catalog.get_collection("one")
    catalog.delete_collection("two")
    assert catalog.count_collections() == 1
    catalog.create_tenant("t")
    catalog.create_database("d", "t")
    catalog.create_collection("uno", tenant="t", database="d")
    assert catalog.list_databases("t") == ["d"]
    catalog.delete_database("d", "t")
    assert catalog.list_databases("t") == []
    with pytest.raises(CatalogError):
        catalog.create_database("d", "none")


def test_forks_versions_and_garbage(catalog):
    c = make(catalog)
    c.add(["a"], [[1]], documents=["1"])
    c.compact()
    f = c.fork("copy")
    f.add(["b"], [[2]], documents=["2"])
    assert docs(c.get()) == {"a": "1"} and docs(f.get()) == {"a": "1", "b": "2"} and catalog.fork_count(c.version.id) == 1
    first = c.version.version
    c.upsert(["a"], documents=["new"])
    c.compact()
    c.version = catalog.restore(c.version, first)
    assert docs(c.get()) == {"a": "1"}
    assert catalog.collect_garbage(keep=1, older_than=0) and docs(c.get()) == {"a": "1"} and docs(f.get()) == {"a": "1", "b": "2"}
    catalog.delete_collection("copy")
    catalog.collect_garbage(keep=1, older_than=0)
    assert catalog.fork_count(c.version.id) == 0 and docs(c.get()) == {"a": "1"}


def test_transactions(catalog):
    c = make(catalog)
    c.add(["a", "b"], [[1], [2]], documents=["1", "2"])
    t = c.transaction()
    assert docs(t.get(["a"])) == {"a": "1"}
    t.update("a", document="t")
    with pytest.raises(ValueError):
        t.delete("a")
    Collection(catalog, catalog.get_collection("things")).update(["b"], documents=["other"])
    t.commit()
    assert docs(c.get()) == {"a": "t", "b": "other"}
    t = c.transaction()
    t.get(["a"])
    t.delete("b")
    Collection(catalog, catalog.get_collection("things")).update(["a"], documents=["mine"])
    with pytest.raises(Conflict):
        t.commit()
    stale = Collection(catalog, c.version)
    c.refresh().update(["a"], documents=["x"])
    with pytest.raises(Conflict):
        stale.update(["a"], documents=["y"])


def test_attached_functions_over_compactions(catalog):
    c = make(catalog)
    c.attach_function("stats", "statistics")
    c.attach_function("count", "record_counter")
    c.attach_function("history", "revision_history")
    with pytest.raises(CatalogError):
        c.attach_function("stats", "statistics")
    with pytest.raises(KeyError):
        c.attach_function("x", "unknown")
    c.add(["1", "2", "3"], [[1], [1], [1]], [{"category": "A", "score": 10, "active": True}, {"category": "B", "score": 10, "active": False}, {"category": "A", "score": 20, "active": True}], ["d1", "d2", "d3"])
    c.compact()
    s = incremental.read_statistics(c.function_output("stats"))
    assert s == {"statistics": {"category": {"A": {"count": 2}, "B": {"count": 1}}, "score": {"10": {"count": 2}, "20": {"count": 1}}, "active": {"true": {"count": 2}, "false": {"count": 1}}}, "summary": {"total_count": 3}}
    c.update(["1"], metadatas=[{"category": "B", "tags": ["u", "v"]}], documents=["d1b"])
    c.delete(ids=["3"])
    c.compact()
    s = incremental.read_statistics(c.function_output("stats"), ["category", "tags"])
    assert s == {"statistics": {"category": {"B": {"count": 2}}, "tags": {"u": {"count": 1}, "v": {"count": 1}}}, "summary": {"total_count": 2}}
    assert c.function_output("count").first()["total_count"] == 2
    h = {r["id"]: (r["document"], r["is_delete"]) for r in c.function_output("history").collect()}
    assert h == {"1::v1": ("d1", False), "1::v2": ("d1b", False), "2::v1": ("d2", False), "3::v1": ("d3", False), "3::v2": (None, True)}
    with pytest.raises(ValueError):
        incremental.read_statistics(c.function_output("stats"), [str(i) for i in range(31)])
    c.detach_function("stats")
    with pytest.raises(CatalogError):
        c.function_output("stats")


def test_source_versions_map_to_positions_and_repeat_safely(spark):
    schema = "id string, log_offset long, op string, document string, source_version long"
    log = [("a", 1, "add", "1", 5), ("a", 2, "update", "2", 6), ("a", 3, "update", "again", 6), ("a", 4, "delete", None, None), ("a", 5, "add", "new", 1), ("a", 6, "update", "new2", 2)]
    df = spark.createDataFrame(log, schema)
    got = incremental.revision_history(df, version_key="v")
    assert sorted((r["version"], r["document"], r["source_version"]) for r in got.collect()) == [(1, "1", 5), (2, "2", 6), (3, None, None), (4, "new", 1), (5, "new2", 2)]
    more = incremental.revision_history(df.filter("log_offset >= 6"), got, "v")
    assert more.count() == 5


def test_sparse_vectors_and_schema_of_a_collection(catalog):
    c = make(catalog, sparse={"key": "bm25", "idf": True}, embedding_function={"name": "hashing"}, schema={"disabled": {"secret": ["str"]}, "full_text": False})
    c.add(["a", "b", "c"], documents=["shard filter shard", "filter only", "nothing here"])
    got = c.search(Search().rank(Knn("shards filters", key="bm25", limit=5)).select(K.SCORE)).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["a", "b"]
    for bad in (lambda: c.get(where={"secret": "x"}), lambda: c.count(where_document={"$contains": "x"}), lambda: c.query(query_texts=["x"], where={"secret": "x"}), lambda: c.search(Search().where({"secret": "x"})), lambda: c.search(Search().rank(Knn("x", key="other")))):
        with pytest.raises(ValueError):
            bad()
    s = c.schema.without("*", "bool").having("secret", "str")
    s.check(K("secret") == "x")
    with pytest.raises(ValueError):
        s.check(K("any") == True)  # noqa: E712


def test_results_loader_and_schedule(spark, catalog, tmp_path):
    from lodestrata.plans.results import due, to_frames
    from lodestrata.sources.loader import load_uris

    c = make(catalog)
    c.add(["a", "b"], [[1.0], [2.0]], [{"n": 1}, None])
    two = to_frames(c.query([[1.0], [2.0]], n_results=2))
    assert [list(f["id"]) for f in two] == [["a", "b"], ["b", "a"]] and two[0]["metadata"][0] == {"n": 1}
    assert len(to_frames(c.get())) == 1
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "x.bin").write_bytes(b"\x00\x01")
    recs = spark.createDataFrame([(1, "x.bin"), (2, None), (3, "y.bin")], "id int, uri string")
    assert {r["id"]: r["content"] and bytes(r["content"]) for r in load_uris(spark, recs, str(tmp_path / "img")).collect()} == {1: b"\x00\x01", 2: None, 3: None}
    waiting = spark.createDataFrame([("a", 50, 3), ("b", 5, 1), ("c", 10, 2), ("d", 99, 9)], "collection string, waiting int, oldest int")
    assert [r[0] for r in due(waiting, 2).collect()] == ["c", "a"] and [r[0] for r in due(waiting, 9, skip=["c"]).collect()] == ["a", "d"]


def test_an_index_is_built_and_kept_by_compaction(catalog, spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 6)).round(3)
    config = {"space": "cosine", "index": {"cell_rows": 40, "probes": 1000, "rerank": 200}}
    c = Collection(catalog, catalog.create_collection("cells", config=config))
    plain = Collection(catalog, catalog.create_collection("plain", config={"space": "cosine"}))
    frame = lambda lo, hi: spark.createDataFrame([(f"r{i:03d}", f"t{i}", x[i].tolist(), json.dumps({"n": i % 5})) for i in range(lo, hi)], "id string, document string, embedding array<double>, metadata string")

    def same(level="index_and_wal", **kw):
        got, want = ({(r["query_id"], r["rank"], r["id"]) for r in y.query(query_embeddings=x[:12].tolist(), n_results=4, level=level, **kw).collect()} for y in (c, plain))
        assert got == want and got

    for y in (c, plain):
        y.write_frame(frame(0, 250))
        y.compact()
    assert c.version.index and plain.version.index is None
    same()
    for y in (c, plain):
        y.write_frame(frame(250, 400))
        y.delete(ids=["r000", "r251"])
        y.update(ids=["r005"], embeddings=[x[6].tolist()])
    same()
    same(level="index_only")
    same(where={"n": 3})
    first = c.version.index
    for y in (c, plain):
        y.compact()
    assert c.version.index != first
    same()
    kept = catalog.read_index(c.version)
    assert kept.rows.select("id").distinct().count() == 398 and kept.rows.groupBy("cell").count().agg({"count": "max"}).first()[0] <= 400


def test_frames_are_checked_and_vectorised_as_lists_are(catalog, spark):
    config = {"embedding_function": {"name": "hashing"}, "sparse": {"key": "bm25"}}
    a, b = (Collection(catalog, catalog.create_collection(n, config=config)) for n in ("lists", "frames"))
    texts = ["red apples", "blue sky over apples", None]
    a.upsert(["x", "y", "z"], documents=texts, embeddings=[None, None, [0.0] * 64], metadatas=[{"k": 1}, {"k": 2}, {"k": 3}])
    rows = [("x", texts[0], None, '{"k": 1}'), ("y", texts[1], None, '{"k": 2}'), ("z", None, [0.0] * 64, '{"k": 3}'), (None, "no id", None, None)]
    schema = "id string, document string, embedding array<float>, metadata string"
    assert b.write_frame(spark.createDataFrame(rows, schema)) == 3
    both = [sorted((r["id"], tuple(r["embedding"]), str(sorted(r["metadata"].items()))) for r in y.get(include=("embeddings", "metadatas")).collect()) for y in (a, b)]
    assert both[0] == both[1]
    for bad in ([rows[0], rows[0]], [("w", None, [1.0, 2.0], None)]):
        with pytest.raises(ValueError):
            b.write_frame(spark.createDataFrame(bad, schema))
    with pytest.raises(ValueError):
        b.write_frame(spark.createDataFrame([("w", None, None, None)], schema), "add")
    assert b.write_frame(spark.createDataFrame([], schema)) == 0


def test_files_are_created_once_and_young_garbage_stays(spark, tmp_path):
    store = Storage(spark, str(tmp_path / "s"))
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda n: store.write({"n": n}, "a", "b.json"), range(16)))
    assert sum(won) == 1 and store.read("a", "b.json") == {"n": won.index(True)} and store.list("a") == ["b.json"]
    catalog = Catalog(spark, str(tmp_path / "c"))
    rows = spark.createDataFrame([], "id string, log_offset bigint, op string, document string, embedding array<float>, metadata string")
    name = catalog.write_log(rows)
    assert catalog.collect_garbage() == [] and catalog.collect_garbage(older_than=0) == [name]


def test_vector_keys_are_checked(catalog):
    c = Collection(catalog, catalog.create_collection("gate", config={"sparse": {"key": "bm25"}, "embedding_function": {"name": "hashing"}}))
    c.upsert(["a"], documents=["red apples"])
    assert c.search({"rank": {"$knn": {"query": "apples", "key": "bm25"}}}).count() == 1
    with pytest.raises(ValueError):
        c.search({"rank": {"$knn": {"query": {"indices": [1], "values": [1.0]}, "key": "other"}}})


def test_a_segment_as_log_and_partitions_of_a_size(catalog, spark):
    c = Collection(catalog, catalog.create_collection("again"))
    c.add([f"r{i}" for i in range(30)], embeddings=[[float(i)] for i in range(30)])
    c.compact()
    segment = catalog.read_segment(c.version)
    log = oplog.segment_as_log(segment)
    anew = oplog.materialize(log, segment.limit(0))
    assert {(r["id"], r["mat_op"]) for r in anew.collect()} == {(f"r{i}", "add_new") for i in range(30)}
    parts = [oplog.segment_as_log(segment, 3, n) for n in range(3)]
    assert sum(p.count() for p in parts) == 30 and oplog.segment_as_log(segment, 3).select("shard").distinct().count() == 3
    assert oplog.partition_log(log, most_rows=10).rdd.getNumPartitions() == 3


def test_a_compaction_loop_works_off_the_longest_waiting(catalog):
    for n, size in (("few", 3), ("many", 25)):
        c = Collection(catalog, catalog.create_collection(n))
        c.add([f"r{i}" for i in range(size)], embeddings=[[float(i)] for i in range(size)], documents=[str(i) for i in range(size)])
    assert maintenance.compact_due(catalog, most_rows=15) == ["many"]
    c = Collection(catalog, catalog.get_collection("many"))
    assert c.version.log_position == 15 and c.version.total_records == 15 and c.get().count() == 25
    assert maintenance.run(catalog, rounds=2, pause=0.0, most_rows=15) == 1 and c.refresh().version.total_records == 25
    assert maintenance.compact_due(catalog) == [] and catalog.get_collection("few").log_position == 0


def test_a_function_over_several_inputs(catalog):
    a, b = (Collection(catalog, catalog.create_collection(n)) for n in ("first", "second"))
    a.attach_function("n", "record_counter")
    a.add_input("n", b)
    for c, n in ((a, 2), (b, 3)):
        c.add([f"r{i}" for i in range(n)], embeddings=[[float(i)] for i in range(n)])
    a.compact()
    assert {(r["input"], r["total_count"]) for r in a.function_outputs("n").collect()} == {("first", 2)}
    b.compact()
    assert {(r["input"], r["total_count"]) for r in a.function_outputs("n").collect()} == {("first", 2), ("second", 3)}
    with pytest.raises(CatalogError):
        a.add_input("none", b)


def test_configurations_are_checked(catalog):
    catalog.create_collection("fine", config={"space": "ip", "graph": {"ef_search": 100, "resize_factor": 1.2}, "index": {"probes": 64, "rerank": None, "epsilon": 0.5}})
    for bad in ({"space": "l3"}, {"graph": {"ef": 10}}, {"graph": {"max_neighbors": 0}}, {"index": {"probes": 1.5}}, {"index": {"cell_rows": True}}):
        with pytest.raises(CatalogError):
            catalog.create_collection("bad", config=bad)
    assert catalog.count_collections() == 1
