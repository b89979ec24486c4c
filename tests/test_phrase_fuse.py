import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators.phrase import phrase_ids, trigram_postings
from lodestrata.operators.rank import RankError, fuse


def test_phrases_are_found_as_substrings(spark):
    texts = ["abcabcabc", "abc abd", "", None, "ab", "aaaaaaa", "日本語のテキスト", "x😀y😀z", "cabcab"]
    post = trigram_postings(spark.createDataFrame(list(enumerate(texts)), "d int, t string"), "d", "t").cache()
    for phrase in ("abc", "abcab", "aaaa", "aaaaaaaa", "語のテ", "😀y😀", "bcabca", "nope"):
        assert {r["id"] for r in phrase_ids(post, phrase).collect()} == {n for n, t in enumerate(texts) if t and phrase in t}
    with pytest.raises(ValueError):
        phrase_ids(post, "ab")


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab😀é ", max_size=12), min_size=1, max_size=20))
def test_grams(spark, texts):
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.grams(F.col("t")).alias("g")).collect()
    assert [r["g"] for r in got] == [[t[i : i + 3] for i in range(len(t) - 2)] for t in texts]


def test_fusion_of_many_queries(spark):
    rng = np.random.default_rng(3)
    lists = [{(q, int(i)): n + 1 for q in range(5) for n, i in enumerate(rng.permutation(30)[:12])} for _ in range(3)]
    frames = [spark.createDataFrame([(q, i, r) for (q, i), r in x.items()], "query_id long, id long, rank long") for x in lists]
    for weights, default in (([1.0, 1.0, 1.0], None), ([3.0, 1.0, 0.5], 100.0)):
        score = {}
        for key in set().union(*lists):
            score[key] = -sum(w / (60 + x[key] - 1) if key in x else 0.0 if default is None else w / (60 + default) for x, w in zip(lists, weights))
        want = {(q, i, n + 1) for q in range(5) for n, i in enumerate(sorted((i for p, i in score if p == q), key=lambda i: (round(score[q, i], 12), i))[:7])}
        assert {(r["query_id"], r["id"], r["rank"]) for r in fuse(frames, weights, 60.0, default, 7).collect()} == want
    with pytest.raises(RankError):
        fuse(frames, [1.0])
