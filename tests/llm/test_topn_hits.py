import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm.hits import component, component_ranking, first_wanted, grouped_top_k
from lodestrata.llm.topn import top_n

HITS = "search_id long, offset_id long, shard_index int, score double, category string, pub_year int, priority int, leaf_dense double, leaf_sparse double, leaf_age double, leaf_clicks double, extra string"
SEARCHES = "search_id long, group_keys array<string>, agg_op string, agg_key string, agg_k int, want int"


def hit(s, o, score, cat=None, year=None, prio=None, leaves=(None, None, None, None)):
    return (s, o, 0, score, cat, year, prio, *leaves, "x")


def brute(hits, searches):
    best = {}
    for h in hits:
        if h[3] is not None and h[3] == h[3] and ((h[0], h[1]) not in best or h[3] < best[h[0], h[1]][3]):
            best[h[0], h[1]] = h
    out = []
    for s, keys, op, key, k, _ in searches:
        groups = {}
        for h in best.values():
            if h[0] == s:
                field = {"#score": h[3], "category": h[4], "pub_year": h[5], "priority": h[6]}
                groups.setdefault(tuple(field[x] for x in keys), []).append((field[key], h[3], h[1]))
        for members in groups.values():
            down = op == "$max_k"
            members.sort(key=lambda m: (m[1], m[2]))
            present = sorted([m for m in members if m[0] is not None], key=lambda m: m[0], reverse=down)
            missing = [m for m in members if m[0] is None]
            out += [(s, m[2]) for m in (present + missing if down else missing + present)[: max(k or 0, 0)]]
    return sorted(out)


@pytest.mark.parametrize("heavy", [20_000, 5])
def test_grouped_top_k(spark, heavy):
    rng = random.Random(2)
    hits = []
    for _ in range(900):
        s, o = rng.choice([1, 1, 1, 2, 3, 4, 5]), rng.randrange(160)
        r2 = random.Random(s * 1000 + o)
        hits.append(hit(s, o, rng.choice([None, 0.5, 1.0, rng.random(), float("nan")]), r2.choice([None, "", "a", "A"]), r2.choice([None, 2001, 2002]), r2.choice([None, 1, 2])))
    searches = [(1, ["category"], "$min_k", "priority", 3, 1), (2, ["category", "pub_year"], "$max_k", "#score", 2, 1), (3, ["pub_year"], "$max_k", "category", 4, 1), (4, [], "$min_k", "category", 7, 1), (5, ["priority"], "$min_k", "#score", 0, 1), (9, ["priority"], "$min_k", "#score", 2, 1)]
    got = grouped_top_k(spark.createDataFrame(hits, HITS), spark.createDataFrame(searches, SEARCHES), heavy)
    assert sorted((r[0], r[1]) for r in got.collect()) == brute(hits, searches)


def test_top_n_of_hot_groups_is_exact(spark):
    df = spark.range(3000).select((F.col("id") % 7 == 0).alias("g"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"), "id", F.lit(40).alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hot = top_n(df, ["g"], [F.col("v").desc(), F.col("id").asc()], "n", 100)
        light = top_n(df, ["g"], [F.col("v").desc(), F.col("id").asc()], "n", 10_000)
        assert sorted(map(tuple, hot.collect())) == sorted(map(tuple, light.collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_empty_tables(spark):
    none = spark.createDataFrame([], HITS), spark.createDataFrame([], SEARCHES)
    assert grouped_top_k(*none).count() == 0 and first_wanted(*none).count() == 0


def test_component_orients_and_lifts_loadings():
    w = component(np.array([[1.0, -0.9, 0], [-0.9, 1.0, 0], [0, 0, 1.0]]), 0.25)
    assert np.allclose(w, [0.5**0.5, 0.5**0.5, 0.25]) and not component(np.zeros((2, 2)), 0.25).any()


@pytest.mark.parametrize("heavy", [None, 10])
def test_first_wanted_counts_all_leaves_alike(spark, heavy):
    rng = random.Random(5)
    hits, planted = [], set()
    for s in (1, 2):
        for o in range(300):
            good = o < 6
            u = [rng.random() * (0.03 if good else 1) + (0 if good else 0.03 * rng.random()) for _ in range(4)]
            leaves = (u[0] * 2, 1e3 / (u[1] + 1e-3), u[2] * 1e7, 1e6 / (u[3] + 1e-4))
            if not good and rng.random() < 0.2:
                leaves = tuple(None if rng.random() < 0.5 else x for x in leaves)
            hits += [hit(s, o, None, leaves=leaves)] * rng.choice([1, 2])
            if good:
                planted.add((s, o))
    got = first_wanted(spark.createDataFrame(hits, HITS), spark.createDataFrame([(1, [], "$min_k", "#score", 1, 6), (2, [], "$min_k", "#score", 1, 6), (3, [], "$min_k", "#score", 1, 6)], SEARCHES), heavy)
    assert {(r["search_id"], r["offset_id"]) for r in got.collect()} == planted


@pytest.mark.parametrize("heavy", [None, 0])
def test_ranks_of_ties_nulls_and_constant_leaves(spark, heavy):
    df = spark.createDataFrame([("g", 1, 1.0, None, 5.0), ("g", 2, 1.0, 2.0, 5.0), ("g", 3, 3.0, 1.0, 5.0), (None, 4, None, None, None)], "g string, i int, a double, b double, c double")
    keys = {(r["g"], r["i"]): r["key"] for r in component_ranking(df, "g", "i", {"a": False, "b": True, "c": False}, heavy_rows=heavy).collect()}
    assert len(keys) == 4 and keys[None, 4] == 0.0 and keys["g", 2] < keys["g", 1] and keys["g", 2] < keys["g", 3]


def test_the_limit_of_light_groups_follows_the_rows():
    from lodestrata.llm.topn import heavy_limit

    assert [heavy_limit(n) for n in (0, 10_000, 1_000_000, 10**12)] == [2_000, 2_000, 5_000, 1_000_000]


def test_hot_half_by_default(spark):
    df = spark.range(9000).select((F.col("id") % 3 == 0).alias("g"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"), "id")
    out = top_n(df, ["g"], [F.col("v").asc(), F.col("id").asc()], 25)
    assert "_chunk" in out._jdf.queryExecution().toString()
    rows = sorted(df.collect(), key=lambda r: (r["v"], r["id"]))
    assert sorted(r["id"] for r in out.collect()) == sorted(r["id"] for g in (True, False) for r in [x for x in rows if x["g"] == g][:25])


def test_light_and_heavy_groups_are_ranked_alike(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), n, *[rng.choice([None, float(rng.randrange(6)), float("nan")]) for _ in range(3)]) for n in range(200)]
    df = spark.createDataFrame(rows, "g string, i int, a double, b double, c double")
    light, heavy = ({(r["g"], r["i"], r["key"]) for r in component_ranking(df, "g", "i", {"a": False, "b": True, "c": True}, heavy_rows=n).collect()} for n in (1000, 0))
    assert light == heavy and len(light) == 200
