import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import metadata as M
from lodestrata.operators.where import DOCUMENT, FlatBinding, IndexSchema, K, Key, MapBinding, WhereError, combined, compile_where, filter_ids, leaf, matches_empty, parse_where, parse_where_document

SCALARS = st.one_of(st.integers(-2, 3), st.sampled_from([0.5, 1.0, 2.0, -1.5]), st.sampled_from(["a", "b", "cat"]), st.booleans())
DOCS = [None, "", "the cat sat", "a dog and a cat", "Cat", "x.y"]
KEYS = ["p", "q"]


def leaves():
    key = st.sampled_from(KEYS)
    eq = st.builds(lambda k, o, v: leaf(k, o, v), key, st.sampled_from(["$eq", "$ne"]), SCALARS)
    rng = st.builds(lambda k, o, v: leaf(k, o, v), key, st.sampled_from(["$gt", "$gte", "$lt", "$lte"]), st.one_of(st.integers(-2, 3), st.sampled_from([0.5, 1.5])))
    isin = st.builds(lambda k, o, v: leaf(k, o, v), key, st.sampled_from(["$in", "$nin"]), st.one_of(st.lists(st.integers(-2, 3), min_size=1, max_size=3), st.lists(st.sampled_from(["a", "b"]), min_size=1, max_size=2)))
    arr = st.builds(lambda o, v: leaf("arr", o, v), st.sampled_from(["$contains", "$not_contains"]), SCALARS)
    doc = st.builds(lambda o, v: leaf(DOCUMENT, o, v), st.sampled_from(["$contains", "$not_contains", "$regex", "$not_regex"]), st.sampled_from(["cat", "a", "o.", "x*", "[A-Z]at"]))
    return st.one_of(eq, rng, isin, arr, doc)


TREES = st.recursive(leaves(), lambda c: st.builds(lambda o, m: parse_where({o: [x.to_dict() for x in m]}), st.sampled_from(["$and", "$or"]), st.lists(c, min_size=1, max_size=3)), max_leaves=6)


def same(a, b):
    num = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    return (num(a) and num(b) and a == b) or (type(a) is type(b) and a == b)


def holds(w, rec):
    if hasattr(w, "members"):
        return (all if w.op == "$and" else any)(holds(m, rec) for m in w.members)
    op, v = w.op, w.value
    negative = op in ("$ne", "$nin", "$not_contains", "$not_regex")
    if w.key == DOCUMENT:
        d = rec["doc"]
        hit = (d is not None and v in d) if "contains" in op else matches_empty(v) or (d is not None and re.search(v, d) is not None)
    else:
        x = rec["meta"].get(w.key)
        if op in ("$eq", "$ne"):
            hit = x is not None and same(x, v)
        elif op in ("$in", "$nin"):
            hit = x is not None and any(same(x, y) for y in v)
        elif "contains" in op:
            hit = isinstance(x, list) and any(same(y, v) for y in x)
        else:
            hit = isinstance(x, (int, float)) and not isinstance(x, bool) and {"$gt": x > v, "$gte": x >= v, "$lt": x < v, "$lte": x <= v}[op]
    return not hit if negative else hit


RECORDS = [{"id": f"r{i}", "doc": DOCS[i % 6], "meta": {k: v for k, v in (("p", [None, 1, 2.0, "a", True, -1.5, "cat"][i % 7]), ("q", [None, "b", 0, 0.5][i % 4]), ("arr", [None, [1, 2], ["a", "b"], [0.5], [True]][i % 5])) if v is not None}} for i in range(30)]


@pytest.fixture(scope="module")
def frame(spark):
    df = spark.createDataFrame([(r["id"], r["doc"], M.encode_map(r["meta"])) for r in RECORDS], f"id string, document string, metadata {M.META}")
    return df.cache()


@settings(max_examples=40, deadline=None)
@given(TREES)
def test_random_trees_equal_the_model(frame, tree):
    got = {r["id"] for r in frame.filter(compile_where(tree, MapBinding())).select("id").collect()}
    assert got == {r["id"] for r in RECORDS if holds(tree, r)}
    assert parse_where(tree.to_dict()).to_dict() == tree.to_dict()


def test_flat_binding_pushes_filters_and_keeps_missing_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "en", 5), (2, None, 7), (3, "de", None)], "id int, lang string, n int").write.parquet(path)
    df = spark.read.parquet(path)
    b = FlatBinding(df, {"lang": "lang", "n": "n"})
    run = lambda w: sorted(r["id"] for r in df.filter(compile_where(w, b)).collect())
    assert run(Key("lang") != "en") == [2, 3] and run(Key("n") > 5.5) == [2] and run(Key("n").not_in([7])) == [1, 3]
    assert run(Key("lang") == 5) == [] and run(Key("nope") != 1) == [1, 2, 3] and run(K.ID.is_in([1, 9])) == [1]
    plan = df.filter(compile_where(Key("lang") == "en", b))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan


@pytest.mark.parametrize("bad", [{"a": 1, "b": 2}, {"$and": []}, {"a": {"$in": []}}, {"a": {"$in": [1, "x"]}}, {"a": {"$gt": "x"}}, {"a": {"$gt": True}}, {"a": {"$what": 1}}, {"a": None}, {"a": {"$regex": "x"}}, {"#document": {"$eq": "x"}}, {"#document": {"$contains": ""}}, {"#document": {"$regex": "(?=x)"}}, {"#document": {"$regex": r"(a)\1"}}, {"#document": {"$regex": "("}}])
def test_malformed_predicates(bad):
    with pytest.raises(WhereError):
        parse_where(bad)


def test_document_filters_and_combination():
    w = combined({"a": 1}, {"$or": [{"$contains": "x"}, {"$not_regex": "y"}]})
    assert w.to_dict() == {"$and": [{"a": {"$eq": 1}}, {"$or": [{"#document": {"$contains": "x"}}, {"#document": {"$not_regex": "y"}}]}]}
    assert combined(None, {}) is None and parse_where_document(None) is None


def test_legality_gate():
    s = IndexSchema({"a": frozenset({"str"}), "*": frozenset({"bool"})}, full_text=False)
    s.check(parse_where({"a": 1}))
    for w in ({"a": "x"}, {"b": True}, {"#document": {"$contains": "x"}}):
        with pytest.raises(WhereError):
            s.check(parse_where(w))
    with pytest.raises(WhereError):
        s.check_key("sparse")


def test_allow_lists(spark, frame):
    ids = lambda x: sorted(r["id"] for r in filter_ids(frame, x).select("id").collect())
    assert ids(["r1", "r1", "zz"]) == ["r1"] and ids([]) == [] and len(ids(None)) == 30
    assert ids(spark.createDataFrame([("r2",), ("r2",), ("zz",)], "x string")) == ["r2"]
    assert len(ids([f"r{i}" for i in range(2000)])) == 30


def test_metadata_round_trip_merge_and_delta(spark):
    sv = M.SparseVector((1, 5), (0.5, 2.0), ("a", "b"))
    meta = {"b": True, "i": 3, "f": 1.5, "s": "x", "l": [1, 2], "t": ["u"], "v": sv}
    row = spark.createDataFrame([(M.encode_map(meta),)], f"m {M.META}").first()["m"]
    assert {k: M.decode(v) for k, v in row.items()} == meta
    for bad in ({"": 1}, {"#x": 1}, {"a": []}, {"a": [1, "x"]}, {"a": {}}, {"a": float("nan")}):
        with pytest.raises(ValueError):
            M.validate(bad)
    with pytest.raises(ValueError):
        M.SparseVector((2, 1), (1.0, 1.0))
    j = spark.createDataFrame([('{"a": 1, "b": "x", "c": [1.5], "d": true}', '{"a": 2, "b": null, "e": "new"}')], "o string, n string").select(M.from_json(F.col("o")).alias("o"), M.from_json(F.col("n")).alias("n"))
    out = j.select(M.merged(F.col("o"), F.col("n")).alias("m"), M.delta(F.col("o"), M.merged(F.col("o"), F.col("n"))).alias("d")).first()
    assert {k: M.decode(v) for k, v in out["m"].items()} == {"a": 2, "c": [1.5], "d": True, "e": "new"}
    assert set(out["d"]["inserts"]) == {"e"} and set(out["d"]["deletes"]) == {"b"} and set(out["d"]["updates"]) == {"a"}
