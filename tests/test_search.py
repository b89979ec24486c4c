import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import metadata as M
from lodestrata.functions import text as T
from lodestrata.functions.distance import SPACES, distance, matrix, normalized
from lodestrata.functions.embedding import Bm25, Hashing, embed_missing
from lodestrata.operators.cells import CellIndex, build_cells, kmeans, search_cells
from lodestrata.operators.knn import knn, merge
from lodestrata.operators.rank import Knn, RankError, Val, evaluate, parse_rank, rrf
from lodestrata.operators.sparse import bm25_weights, sparse_knn
from lodestrata.operators.where import K, Key
from lodestrata.plans import search as P

RNG = np.random.default_rng(2)
X = RNG.normal(size=(300, 8)).astype(np.float32)


@pytest.fixture(scope="module")
def corpus(spark):
    bad = [(900, None), (901, [1.0] * 3), (902, [None] * 8)]
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)] + bad, "id long, embedding array<float>").cache()


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(i, [float(v) for v in X[i] + 0.01]) for i in range(5)], "query_id long, query array<double>")


def want(space, k, upto=300):
    d = matrix((X[:5] + 0.01).astype(float), X[:upto].astype(float), space)
    return {(q, r + 1, int(i)) for q in range(5) for r, i in enumerate(np.argsort(d[q], kind="stable")[:k])}


@pytest.mark.parametrize("space", SPACES)
def test_exact_neighbours(corpus, asked, space):
    got = knn(corpus, asked, 7, space)
    assert {(r["query_id"], r["rank"], r["id"]) for r in got.collect()} == want(space, 7)


def test_many_queries_go_block_by_block(corpus, asked, monkeypatch):
    monkeypatch.setattr("lodestrata.operators.knn.QUERY_BLOCK", 2)
    assert {(r["query_id"], r["rank"], r["id"]) for r in knn(corpus, asked, 3).collect()} == want("l2", 3)


def test_edges(spark, corpus, asked):
    assert knn(corpus.limit(0), asked, 3).count() == 0 and knn(corpus, asked.limit(0), 3).count() == 0
    assert knn(corpus, asked, 1000).count() == 5 * 300
    with pytest.raises(ValueError):
        knn(corpus, asked, 0)
    twice = corpus.unionByName(corpus)
    assert {(r["query_id"], r["rank"], r["id"]) for r in knn(twice, asked, 3).collect()} == want("l2", 3)
    assert {(r["query_id"], r["rank"], r["id"]) for r in merge([knn(corpus.filter("id % 2 = 0"), asked, 4), knn(corpus.filter("id % 2 = 1"), asked, 4)], 4).collect()} == want("l2", 4)


def test_cells_with_and_without_codes(spark, corpus, asked, tmp_path):
    index = build_cells(corpus, 12)
    index.write(str(tmp_path / "ix"))
    again = CellIndex.read(spark, str(tmp_path / "ix"))
    assert {(r["query_id"], r["rank"], r["id"]) for r in search_cells(again, asked, 5, 12).collect()} == want("l2", 5)
    for kw in ({"probes": 9}, {"probes": 12, "rerank": 60}):
        got = {(r["query_id"], r["id"]) for r in search_cells(index, asked, 5, **kw).collect()}
        assert len(got & {(q, i) for q, _, i in want("l2", 5)}) >= 23
    loads = np.bincount(matrix(X.astype(float), kmeans(X.astype(float), 6, balance=1.0), "l2").argmin(1))
    assert loads.min() > 0


def test_large_query_sets_meet_the_cells_in_a_cogroup(corpus, monkeypatch):
    every = corpus.filter("id < 300").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    index = build_cells(corpus, 6)
    rows = lambda df: {(r["query_id"], r["rank"], r["id"]) for r in df.collect()}
    few, exact, codes = rows(search_cells(index, every, 4, 2)), rows(knn(corpus, every, 4)), rows(search_cells(index, every, 4, 3, rerank=30))
    monkeypatch.setattr("lodestrata.operators.knn.QUERY_BLOCK", 100)
    monkeypatch.setattr("lodestrata.operators.knn.CORPUS_BLOCK", 70)
    monkeypatch.setattr("lodestrata.operators.cells.CELL_BLOCK", 20)
    assert rows(search_cells(index, every, 4, 2)) == few and rows(search_cells(index, every, 4, 3, rerank=30)) == codes
    assert rows(search_cells(index, every, 4, 6)) == exact and rows(knn(corpus, every, 4)) == exact


def test_an_index_is_kept_up_with_changes(spark, corpus, asked, tmp_path):
    index = build_cells(corpus.filter("id < 200"), 4).write(str(tmp_path / "ix"))
    index = index.changed(corpus.filter("id < 20").select("id"), corpus.filter("id < 10 or id >= 200").select("id", F.col("embedding").alias("vector")))
    kept = index.maintained(cell_rows=40)
    sizes = {r["cell"]: r["count"] for r in kept.rows.groupBy("cell").count().collect()}
    assert len(kept.centres) > 4 and set(sizes) <= set(range(len(kept.centres)))
    now = corpus.filter("(id < 10 or id >= 20) and id < 300")
    assert {r["id"] for r in kept.rows.select("id").collect()} == {r["id"] for r in now.select("id").collect()}
    rows = lambda df: {(r["query_id"], r["rank"], r["id"]) for r in df.collect()}
    assert rows(search_cells(kept, asked, 5, len(kept.centres))) == rows(knn(now, asked, 5))
    few = CellIndex(kept.rows, kept.centres, kept.space).maintained(cell_rows=4000)
    assert len(few.centres) < len(kept.centres) and rows(search_cells(few, asked, 5, len(few.centres))) == rows(knn(now, asked, 5))
    same = spark.range(300).select("id", F.array(*[F.lit(1.0).cast("float")] * 4).alias("embedding"))
    assert build_cells(same, 1).maintained(cell_rows=50).rows.select("id").distinct().count() == 300


def test_distance_columns(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>")
    got = df.select(*[distance(F.col("a"), F.col("b"), s).alias(s) for s in SPACES], normalized(F.col("b")).alias("u")).collect()
    assert got[0]["l2"] == 5 and got[0]["ip"] == -4 and abs(got[0]["cosine"] - (1 - 5 / 50**0.5)) < 1e-12
    assert got[1]["cosine"] == 1 and got[2]["l2"] is None and abs(sum(v * v for v in got[0]["u"]) - 1) < 1e-12


def scores(spark, expr, leaves):
    frames = {k: spark.createDataFrame([(i, float(s), n + 1) for n, (i, s) in enumerate(sorted(v.items(), key=lambda x: (x[1], x[0])))], "id long, distance double, rank long") for k, v in leaves.items()}
    r = evaluate(expr, lambda x: frames[x.query])
    return {} if r.frame is None else {x["id"]: x["score"] for x in r.frame.collect()}


def test_rank_domains_meet_as_declared(spark):
    leaves = {"a": {1: 1.0, 2: 2.0, 3: 3.0}, "b": {2: 10.0, 3: 20.0, 4: 30.0}}
    A, B, Ad, Bd = Knn("a"), Knn("b"), Knn("a", default=0.5), Knn("b", default=5.0)
    go = lambda e: scores(spark, e, leaves)
    assert go(A + B) == {2: 12.0, 3: 23.0} and go(A + Bd) == {1: 6.0, 2: 12.0, 3: 23.0}
    assert go(Ad + B) == {2: 12.0, 3: 23.0, 4: 30.5} and go(Ad + Bd) == {1: 6.0, 2: 12.0, 3: 23.0, 4: 30.5}
    assert go(Val(3.0)) == {} and go(1 - A * 2) == {1: -1.0, 2: -3.0, 3: -5.0}
    assert go(A / 0)[1] == float("inf") and np.isnan(go((A - 1) / 0)[1]) and go((A - 1).log())[1] == float("-inf") and np.isnan(go((A - 2).log())[1])
    assert go(A.max(2)) == {1: 2.0, 2: 2.0, 3: 3.0} and go(A.min(B)) == {2: 2.0, 3: 3.0} and go(abs(-A)) == {1: 1.0, 2: 2.0, 3: 3.0}
    assert go(Knn("b", return_rank=True)) == {2: 0.0, 3: 1.0, 4: 2.0}
    f = go(rrf([Knn("a", default=9, return_rank=True), Knn("b", default=9, return_rank=True)], [3, 1], 60, True))
    assert abs(f[2] + (0.75 / 61 + 0.25 / 60)) < 1e-12 and len(f) == 4


def test_rank_json(spark):
    e = (Knn([1.0], limit=5, default=2.0) * 0.5 + Val(1.0) - Knn([2.0], return_rank=True).log()) / 3
    assert parse_rank(e.to_dict()).to_dict() == e.to_dict()
    for bad in ({"$sum": []}, {"$sub": {"left": 1}}, {"$knn": {}}, {"$what": 1}, {"$val": "x"}, {"a": 1, "b": 2}):
        with pytest.raises(RankError):
            parse_rank(bad)
    with pytest.raises(RankError):
        rrf([], k=60)


@pytest.fixture(scope="module")
def records(spark):
    rows = []
    for n in range(1, 31):
        meta = {"category": "ABC"[(n - 1) % 3], "year": 2023 + n % 2, "prio": (n - 1) // 6 + 1, "sv": M.SparseVector((n % 4, 9), (1.0, 0.1))} | ({"opt": n % 2} if n % 7 else {})
        rows.append((f"id_{n}", n, None if n == 5 else f"doc {n}", [float(n), 0.0], M.encode_map(meta)))
    return spark.createDataFrame(rows, f"id string, offset_id long, document string, embedding array<float>, metadata {M.META}").cache()


def test_search_plans(records):
    run = lambda s: [(r["id"], r["score"] if "score" in r.asDict() else None) for r in P.run_search(records, s).orderBy("rank").collect()]
    near = Knn([0.0, 0.0], limit=30)
    assert run(P.Search().rank(near).limit(3).select(K.SCORE)) == [("id_1", 1.0), ("id_2", 4.0), ("id_3", 9.0)]
    by = P.Search().rank(near).select(K.SCORE)
    assert [i for i, _ in run(by.group_by(P.GroupBy(("category",), P.MinK("prio", 1))))] == ["id_1", "id_2", "id_3"]
    assert [i for i, _ in run(by.group_by(P.GroupBy(("category",), P.MaxK(["prio", "#score"], 1))))] == ["id_28", "id_29", "id_30"]
    missing = run(by.group_by(P.GroupBy(("opt",), P.MinK("#score", 1))))
    assert [i for i, _ in missing] == ["id_1", "id_2", "id_7"]
    first = run(by.group_by(P.GroupBy(("category",), P.MinK("opt", 1))))
    assert set(i for i, _ in first) == {"id_7", "id_14", "id_21"}
    assert run(P.Search().where(Key("year") == 2024).limit(2, 1).select(K.SCORE)) == [("id_3", 0.0), ("id_5", 1.0)]
    assert run(P.Search().rank(Knn({"indices": [2], "values": [3.0]}, key="sv", limit=4)).select(K.SCORE))[0] == ("id_2", -2.0)
    row = P.run_search(records, P.Search().only_ids(["id_4"]).select("year", K.DOCUMENT)).first()
    assert row["document"] == "doc 4" and {k: M.decode(v) for k, v in row["metadata"].items()} == {"year": 2023}
    full = P.Search().where({"year": 2023}).rank(near).group_by({"keys": ["category"], "aggregate": {"$min_k": {"keys": ["#score"], "k": 2}}}).limit(4, 1).select_all()
    assert P.Search.from_dict(full.to_dict()).to_dict() == full.to_dict()
    for bad in (lambda: P.Limit(-1), lambda: P.MinK([], 1), lambda: P.MinK("a", 0), lambda: P.GroupBy(("#score",), P.MinK("a", 1)), lambda: P.run_search(records, P.Search().group_by(P.GroupBy(("a",), P.MinK("a", 1)))), lambda: P.run_get(records, include=("nope",))):
        with pytest.raises(P.PlanError):
            bad()


def test_get_and_knn_plans(spark, records):
    assert [r["id"] for r in P.run_get(records, where={"category": "A"}, page=P.Limit(1, 2)).collect()] == ["id_4", "id_7"]
    assert P.run_count(records, where_document={"$not_contains": "doc 1"}).first()["n"] == 19
    q = spark.createDataFrame([(7, [10.2, 0.0])], "query_id long, query array<double>")
    got = P.run_knn(records, q, 2, "l2", where={"category": {"$ne": "A"}}, include=("documents", "distances")).orderBy("rank").collect()
    assert [(r["query_id"], r["id"], r["document"]) for r in got] == [(7, "id_11", "doc 11"), (7, "id_9", "doc 9")]


def test_golden_bm25_vectors_and_tokens(spark):
    texts = ["Usain Bolt's top speed reached ~27.8 mph (44.72 km/h)", "The   space-time   continuum   WARPS   near   massive   objects..."]
    first, second = (Bm25()(t) for t in texts)
    assert first.indices == (230246813, 395514983, 458027949, 488165615, 729632045, 734978415, 997512866, 1114505193, 1381820790, 1501587190, 1649421877, 1837285388)
    assert second.indices == (90097469, 519064992, 737893654, 1110755108, 1950894484, 2031641008, 2058513491)
    assert all(abs(v - 1.6391153) < 1e-5 for v in first.values) and all(abs(v - 1.660867) < 1e-5 for v in second.values)
    df = spark.createDataFrame([(1, texts[0]), (2, None), (3, "")], "id int, text string")
    w = bm25_weights(df, "id", "text").collect()
    assert len(w) == 12 and all(abs(r["weight"] - 1.6391153) < 1e-5 for r in w)
    assert df.select(T.hashed(T.tokens(F.col("text")))).first()[0][0] == T.murmur3("usain")


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("flies", "fli"), ("dies", "die"), ("mules", "mule"), ("agreed", "agre"), ("owned", "own"), ("humbled", "humbl"), ("sized", "size"), ("meeting", "meet"), ("stating", "state"), ("itemization", "item"), ("traditional", "tradit"), ("reference", "refer"), ("colonizer", "colon"), ("plotted", "plot"), ("generously", "generous"), ("skies", "sky"), ("consolidation", "consolid"), ("news", "news"), ("by", "by"), ("say", "say"), ("cry", "cri"), ("knackeries", "knackeri"), ("hoping", "hope"), ("hopping", "hop")])
def test_stems(word, stem):
    assert T.stem(word) == stem


def test_sparse_search_with_and_without_overlap(spark):
    post = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "b", 1.0), (3, "c", 5.0)], "id long, dim string, weight double")
    q = spark.createDataFrame([(0, "a", 1.0), (0, "b", 0.5), (1, "c", 1.0)], "query_id long, dim string, weight double")
    assert sorted(tuple(r) for r in sparse_knn(post, q, 5).select("query_id", "id", "distance").collect()) == [(0, 1, -1.0), (0, 2, 0.5), (1, 3, -4.0)]
    every = sparse_knn(post, q, 5, post.select("id").distinct())
    assert {(r["query_id"], r["id"]): r["distance"] for r in every.collect()}[1, 1] == 1.0 and every.count() == 6


def test_embedding_and_chunks(spark):
    e = Hashing(16)
    df = spark.createDataFrame([("a b", None), (None, None), ("x", [1.0] * 16)], "document string, embedding array<float>")
    got = embed_missing(df, e).collect()
    assert np.allclose(got[0]["embedding"], e.encode(["a b"])[0], atol=1e-6) and got[1]["embedding"] is None and got[2]["embedding"] == [1.0] * 16
    text = "# Title\n\nfirst block\n\n```\ncode\n\nmore\n```\n\n" + "w " * 40
    parts = T.chunk_markdown(text, 40)
    assert parts[0] == "# Title" and all(len(p.encode()) <= 40 for p in parts) and "".join("".join(parts).split()) == "".join(text.split())
    assert [tuple(r) for r in T.chunks(spark.createDataFrame([(1, None), (2, "")], "k int, t string"), "k", "t").collect()] == [(2, 0, " ")]
    assert T.chunk_markdown("\n \n# Title\n\n    code\n    more\n\nnext\x0cpage\n") == ["# Title", "    code\n    more\n\nnext\x0cpage"]
    assert T.chunk_markdown("t\n~~~\na\n\n```\n\nb\n~~~\n\nc", 19) == ["t", "~~~\na\n\n```\n\nb\n~~~", "c"] and T.chunk_markdown("\n\n") == [" "]
    assert json.loads(json.dumps(e.config())) == {"dim": 16, "seed": 0}
