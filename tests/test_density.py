"""Spanning-tree clustering against a serial version; silhouettes against brute force."""

import numpy as np
import pandas as pd
import pytest

from meridian.operators import density
from meridian.plans import registry

DATA = "/root/testdata/sf0.001"


def serial(x, size, samples):
    """Cluster numbers, probabilities and tree weights by Prim's algorithm over all pairs."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, min(samples, n - 1)]
    reach = np.maximum(d, np.maximum(core[:, None], core))
    inside, best, near, tree = np.arange(n) == 0, reach[0].copy(), np.zeros(n, int), []
    while len(tree) < n - 1:
        j = int(np.argmin(np.where(inside, np.inf, best)))
        tree.append((near[j], j, best[j]))
        inside[j] = True
        near = np.where(reach[j] < best, j, near)
        best = np.minimum(best, reach[j])
    weights, top = np.array([w for *_, w in tree]), (-1.0, None)
    for q in np.linspace(0.35, 0.95, 13):
        label = np.arange(n)
        for a, b, w in tree:
            if w <= np.quantile(weights, q):
                label[label == max(label[a], label[b])] = min(label[a], label[b])
        names = [c for c in np.unique(label) if (label == c).sum() >= size]
        sizes = [(label == c).sum() for c in names]
        score = sum(sizes) / n * (0.5 + 0.5 * min(sizes) / max(sizes)) / (1 + 0.05 * len(sizes)) if sizes else 0.0
        if score > top[0]:
            top = (score, np.array([names.index(c) if c in names else -1 for c in label]))
    label, probability = top[1], np.zeros(n)
    for c in set(label) - {-1}:
        worst = core[label == c].max()
        probability[label == c] = 1 - (core[label == c] / worst if worst > 0 else 0.0)
    return label, probability, np.sort(weights)


def clumps(rng, bridge=7, outliers=9):
    """Dense and sparse clumps, a bridge, equal vectors and outliers."""
    return np.concatenate([rng.normal(0, 0.1, (40, 3)), rng.normal(4, 0.5, (30, 3)), np.repeat([[9.0, 0, 0]], 12, 0), np.linspace([0, 0, 0], [4, 4, 4], bridge), rng.uniform(-20, 20, (outliers, 3))])


@pytest.mark.parametrize(("block", "bridge", "outliers", "clusters"), [(4096, 7, 9, 1), (20, 0, 2, 3)])
def test_hdbscan_equals_serial(spark, block, bridge, outliers, clusters):
    x = clumps(np.random.default_rng(1), bridge, outliers)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<double>")
    label, probability, weights = serial(x, 5, 5)
    tree, _ = density.spanning_tree(density.vectors(rows, "vec_id"), 5, block=block)
    assert np.allclose(np.sort([r.w for r in tree.collect()]), weights, atol=1e-12)
    got = density.hdbscan(rows, "vec_id", 5, block=block).toPandas().sort_values("vec_id")
    assert got.cluster.tolist() == label.tolist() and np.allclose(got.probability, probability, atol=1e-12)
    assert len(set(label) - {-1}) == clusters


def test_query_tree_equals_prim(spark):
    """The registered query on the whole smallest table, against the serial version."""
    table = pd.read_parquet(f"{DATA}/embeddings.parquet").sort_values("vec_id")
    label, probability, _ = serial(np.stack(table.embedding.to_numpy()).astype(float), 5, 5)
    registry.load()
    got = registry.QUERIES["model07_hdbscan"](spark, DATA).toPandas().sort_values("vec_id")
    assert got.vec_id.tolist() == table.vec_id.tolist()
    assert got.cluster.tolist() == label.tolist() and np.allclose(got.probability, probability, atol=2e-6)


def test_small_tables(spark):
    schema = "vec_id long, x array<double>"
    assert density.hdbscan(spark.createDataFrame([], schema), "vec_id").count() == 0
    few = density.hdbscan(spark.createDataFrame([(1, [0.0]), (2, [1.0])], schema), "vec_id").collect()
    assert [(r.cluster, r.probability) for r in few] == [(-1, 0.0)] * 2
    odd = spark.createDataFrame([(i, [float("nan"), 1.0 if i < 6 else None]) for i in range(12)], schema)
    got = {r.vec_id: r.cluster for r in density.hdbscan(odd, "vec_id").collect()}
    assert got == serial_labels([[0.0, 1.0]] * 6 + [[0.0, 0.0]] * 6)


def serial_labels(x):
    return dict(enumerate(serial(np.array(x), 5, 5)[0].tolist()))


def test_silhouettes(spark):
    rng = np.random.default_rng(2)
    x, label = clumps(rng), rng.integers(-1, 4, 98)
    label[0] = 9  # alone in its cluster
    rows = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))], "vec_id long, x array<double>, label int")
    d, want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), {}
    for i in np.flatnonzero((label >= 0) & (label != 9)):
        a = d[i, (label == label[i]) & (np.arange(len(x)) != i)].mean()
        b = min(d[i, label == c].mean() for c in set(label.tolist()) - {-1, int(label[i])})
        want[int(i)] = (b - a) / max(a, b)
    got = {r.vec_id: r.silhouette for r in density.silhouettes(rows, "vec_id", "label", block=30).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert abs(density.silhouette(rows, "vec_id", "label").first().silhouette - np.mean(list(want.values()))) < 1e-9
    assert density.silhouette(rows.filter("label = 1"), "vec_id", "label").first().silhouette is None
