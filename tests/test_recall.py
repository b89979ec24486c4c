import os

import numpy as np
import pytest

import __spark_entry__ as entry
from lodestrata.functions.distance import as_matrix, matrix

FOLDERS = [f"/root/testdata/{n}" for n in ("sf0.001", "sf0.01", "sf0.1")]


def recall(spark, name, folder, k=5):
    t = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").toArrow()
    ids, x = t["vec_id"].to_numpy(), as_matrix(t["embedding"], len(t["embedding"][0]))[1]
    asked = np.flatnonzero(ids % 20 == 0)
    d = np.round(matrix(x[asked], x, "l2"), 9)
    true = {(int(ids[q]), int(ids[i])) for q, row in zip(asked, d) for i in np.lexsort((ids, row))[:k]}
    got = {(r["query_id"], r["id"]) for r in entry.queries()[name](spark, folder).collect()}
    assert {q for q, _ in got} == {q for q, _ in true}
    return len(got & true) / len(true)


@pytest.mark.parametrize("name", ["ivf_knn", "quantized_knn"])
def test_recall_of_all_stated_queries(spark, tmp_path, name):
    x = np.random.default_rng(5).normal(size=(3000, 32))
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    for folder in [str(tmp_path), *filter(os.path.isdir, FOLDERS)]:
        r = recall(spark, name, folder)
        print(name, folder, r)
        assert r >= 0.9
