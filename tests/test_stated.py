import os

import numpy as np
import pytest

import __spark_entry__ as entry
from lodestrata.operators.sparse import sparse_knn

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
VECTORS = ["knn_l2", "knn_cosine", "knn_ip", "knn_filtered", "knn_merge_shards", "ivf_knn_all_cells", "query_records"]


@pytest.mark.parametrize("name", VECTORS)
def test_vector_searches_answer_every_stated_id(spark, name):
    """Their rows are held against their SQL in test_entry."""
    stated = {r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 20 = 0").select("vec_id").collect()}
    assert {r["query_id"] for r in entry.queries()[name](spark, SF).select("query_id").collect()} == stated


@pytest.mark.parametrize("name", ["sparse_knn_overlap", "sparse_knn_idf"])
def test_sparse_searches_ask_every_stated_text(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 20 = 0 and text is not null")
    assert {r["query_id"] for r in entry.queries()[name](spark, SF).collect()} == {r[0] for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("signed", [False, True])
def test_many_sparse_queries_in_blocks(spark, monkeypatch, signed):
    monkeypatch.setattr("lodestrata.operators.sparse.QUERY_BLOCK", 30)
    rng = np.random.default_rng(7)
    draw = lambda rows: np.where(rng.random((rows, 40)) < 0.9 / (1 + np.arange(40)), rng.integers(-2 if signed else 1, 4, (rows, 40)), np.nan)
    x, y = draw(700), draw(70)
    long = lambda m, a: spark.createDataFrame([(int(i), f"d{j}", float(m[i, j])) for i, j in np.argwhere(~np.isnan(m))], f"{a} long, dim string, weight double")
    got = {(r["query_id"], r["rank"], r["id"], r["distance"]) for r in sparse_knn(long(x, "id"), long(y, "query_id"), 6).collect()}
    d, met = 1 - np.nan_to_num(y) @ np.nan_to_num(x).T, (~np.isnan(y)).astype(int) @ (~np.isnan(x)).T.astype(int) > 0
    assert got == {(q, n + 1, int(i), d[q, i]) for q in range(70) for n, i in enumerate([i for i in np.argsort(d[q], kind="stable") if met[q, i]][:6])}


@pytest.mark.parametrize("block", [30, 1000])
def test_index_free_sparse_search_hands_on_the_best_only(spark, monkeypatch, block):
    """Every record of all_ids takes part once, no other, and no row for each pair of a query and a record is made."""
    monkeypatch.setattr("lodestrata.operators.sparse.QUERY_BLOCK", block)
    rng = np.random.default_rng(3)
    draw = lambda rows: np.where(rng.random((rows, 60)) < 0.5 / (1 + np.arange(60)), rng.integers(-2, 4, (rows, 60)), np.nan)
    x, y = draw(900), draw(70)
    # Without a common dimension: a query and records of a null one.
    x[:40] = y[0] = np.nan
    long = lambda m, a: spark.createDataFrame([(int(i), f"d{j}", float(m[i, j])) for i, j in np.argwhere(~np.isnan(m))] + [(0, None, 5.0)], f"{a} long, dim string, weight double")
    every = [i for i in range(920) if i % 7]
    found = sparse_knn(long(x, "id"), long(y, "query_id"), 6, spark.createDataFrame([(i,) for i in every + every[:50]], "id long"))
    got = sorted(tuple(r) for r in found.select("query_id", "rank", "id", "distance").collect())
    d = 1 - np.nan_to_num(y) @ np.vstack([np.nan_to_num(x), np.zeros((20, 60))]).T
    asked = [0, *(q for q in range(1, 70) if not np.isnan(y[q]).all())]
    assert got == [(q, n + 1, i, d[q, i]) for q in asked for n, i in enumerate(sorted(every, key=lambda i: (d[q, i], i))[:6])]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "LeftOuter" not in plan
