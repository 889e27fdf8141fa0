"""Tiles of vectors against brute force: far from the origin, with copies, and exactly at the radius."""

import numpy as np

from meridian.operators import density, learn


def pairwise(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<double>")


def test_neighbours_far_from_the_origin(spark):
    """Distances of a clump at 1e6, copies included, have no error of expanded products; equal ones go to the smaller ids."""
    rng = np.random.default_rng(5)
    x = np.concatenate([1e6 + rng.integers(0, 3, (60, 3)) * 0.1, rng.normal(0, 1, (40, 3)), np.full((20, 3), 1e6 + 0.1)])
    d = pairwise(x) + np.diag(np.full(len(x), np.inf))
    want = {(i, r + 1): (int(j), d[i, j]) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), np.round(d[i], 9)))[:6])}
    for block in (9, 4096):
        got = {(r.vec_id, r["rank"]): (r.other, r.dist) for r in learn.neighbours(table(spark, x), "vec_id", 6, block).collect()}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_dbscan_equals_brute_force(spark):
    """Pairs exactly at eps count; rows at no core row's reach are noise; vectors that are not finite meet nobody."""
    rng = np.random.default_rng(6)
    x = np.concatenate([1e5 + np.arange(12)[:, None] * [0.5, 0.0], rng.integers(0, 9, (80, 2)) * 0.5, [[50.0, 50.0], [np.nan, 1.0]]])
    near = pairwise(x) <= 0.5
    core = near.sum(1) >= 3
    label = np.where(core, np.arange(len(x)), -1)
    for _ in range(len(x)):
        label = np.array([min(label[j] for j in np.flatnonzero(near[i] & core)) if core[i] else -1 for i in range(len(x))])
    want = [int(label[i]) if core[i] else int(min((label[j] for j in np.flatnonzero(near[i] & core)), default=-1)) for i in range(len(x))]
    got = {r.vec_id: r.cluster for r in learn.dbscan(table(spark, x), "vec_id", 0.5, 3, block=7).collect()}
    assert [got[i] for i in range(len(x))] == want


def test_lists_of_equal_vectors(spark):
    """A group of copies larger than the list: the smaller ids at distance 0, whatever tile they are in."""
    x = np.concatenate([np.full((50, 2), 1e3 + 0.1), [[1e3, 1e3]]])
    got = density.nearest_lists(density.vectors(table(spark, x), "vec_id"), 4, block=3).filter("id = 40").orderBy("rank").collect()
    assert [(r.other, r.dist) for r in got] == [(i, 0.0) for i in range(4)]
