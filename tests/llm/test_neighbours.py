import numpy as np
import pytest

from lodestrata.llm.neighbours import codes, exact, footrule, nearest_in_file, nearest_pairs, pivot_keys

COLLS = "collection_id string, dim int, space_name string"
VECS = "vec_id long, collection_id string, embedding array<float>, dim string"


def distances(x, y, space):
    return exact(x, np.broadcast_to(y, (len(x), *y.shape)), space)


def brute(vecs, colls, k=5):
    out = set()
    for c, dim, space in colls:
        mine = [(i, np.array(v, np.float32).astype(float)) for i, cc, v in vecs if cc == c and v is not None and len(v) == dim and None not in v and np.isfinite(v).all() and any(v)]
        if not mine:
            continue
        x = np.stack([v for _, v in mine])
        d = distances(x, x, space)
        for n, (i, _) in enumerate(mine):
            near = sorted((d[n, m], j) for m, (j, _) in enumerate(mine) if j != i)[:k]
            out |= {(min(i, j), max(i, j)) for _, j in near}
    return out


def frames(spark, vecs, colls):
    return spark.createDataFrame([(i, c, None if v is None else [None if x is None else float(x) for x in v], "clash") for i, c, v in vecs], VECS), spark.createDataFrame(colls, COLLS)


def found(spark, vecs, colls, **kw):
    return {tuple(r) for r in nearest_pairs(*frames(spark, vecs, colls), **kw).collect()}


def small(rng):
    colls = [("a", 4, "l2"), ("b", 4, "cosine"), ("c", 4, "ip"), ("d", 4, "l2")]
    vecs, n = [], 0
    for c, *_ in colls[:3]:
        for v in rng.normal(size=(20, 4)).round(2):
            vecs.append((n := n + 1, c, v.tolist()))
        for _ in range(9):
            vecs.append((n := n + 1, c, [1.0, 2.0, 0.5, 0.25]))
        for bad in (None, [0.0] * 4, [1.0] * 3, [1.0, None, 1.0, 1.0], [float("nan"), 1, 1, 1]):
            vecs.append((n := n + 1, c, bad))
    vecs += [(n + 1, "d", [1, 1, 1, 1]), (n + 2, "unknown", [1, 1, 1, 1]), (n + 3, None, [1, 1, 1, 1])]
    return vecs, colls


def test_small_collections_with_copies_and_bad_vectors_are_exact(spark):
    vecs, colls = small(np.random.default_rng(1))
    assert found(spark, vecs, colls, posts=30) == brute(vecs, colls)


def test_files_in_blocks_and_pivots_in_slices_give_the_same(spark, monkeypatch):
    vecs, colls = small(np.random.default_rng(2))
    monkeypatch.setattr("lodestrata.llm.neighbours.PIVOT_BYTES", 0)
    monkeypatch.setattr("lodestrata.llm.neighbours.SLICE", 7)
    assert found(spark, vecs, colls, posts=30, block=5) == brute(vecs, colls)


def test_rows_repeated_with_their_id_count_once(spark):
    vecs, colls = small(np.random.default_rng(3))
    assert found(spark, vecs + vecs[:30], colls, posts=30) == brute(vecs, colls)


@pytest.mark.parametrize("space", ["l2", "cosine", "ip"])
def test_recall_of_a_clustered_collection(spark, space):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 2
    x = centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16)) * 0.7
    vecs = [(i, "a", v.tolist()) for i, v in enumerate(x)]
    want = brute(vecs, [("a", 16, space)])
    got = found(spark, vecs, [("a", 16, space)])
    assert len(got & want) / len(want) >= 0.95


def test_empty(spark):
    assert found(spark, [], [("a", 2, "l2")]) == set()


def test_block_pair_ranks_the_other_block():
    x = np.random.default_rng(0).normal(size=(30, 8)).astype(np.float32)
    d = distances(x, x, "l2")
    for rows, at, near in nearest_in_file(x[:12], x[12:], "l2", 3):
        for r, b, dist in zip(rows, at, near, strict=True):
            want = sorted(range(18), key=lambda b: d[r, b + 12])[:3]
            assert b.tolist() == want and dist.tolist() == d[r, np.array(want) + 12].tolist()


def test_footrule_chooses_the_candidates():
    """Few of the pairs of a file are ranked by distance, and the nearest are still among them."""
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(40, 24))[rng.integers(0, 40, 900)] * 2 + rng.normal(size=(900, 24)) * 0.4).astype(np.float32)
    d = distances(x, x, "l2")
    np.fill_diagonal(d, np.inf)
    hit = [len(set(b) & set(np.argsort(d[r])[:5])) for rows, at, _ in nearest_in_file(x, None, "l2", 5, per_root=2.0) for r, b in zip(rows, at, strict=True)]
    assert np.mean(hit) > 4.5


def test_footrule_grows_with_displacement():
    pivots = np.eye(6)
    a = np.array([[6, 5, 4, 3, 2, 1.0]])
    c = codes(np.concatenate([a, a[:, [1, 0, 2, 3, 4, 5]], a[:, ::-1]]), pivots, "ip")
    f = footrule(c[:1], c)[0]
    assert f[0] == 0 and f[1] <= f[2] and f[2] > 0


def test_short_pivots_do_not_take_every_vector():
    rng = np.random.default_rng(6)
    x, p = rng.normal(size=(500, 32)) * 3, rng.normal(size=(40, 32)) * rng.uniform(0.5, 3, size=(40, 1))
    held = lambda b: np.bincount(np.argpartition(pivot_keys(x, p, "l2", b), 4, axis=1)[:, :5].ravel(), minlength=40)
    assert held(0.5).max() < held(0.0).max()
