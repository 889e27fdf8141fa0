"""Pair counts by octaves of distance against loops: equal spots, powers of two, tile edges, repeated and missing ids."""

import math
from collections import Counter

import numpy as np
import pytest

from meridian.operators import linking, octaves

SCHEMA = "id long, x double, y double"


def serial(rows, radius):
    out = Counter()
    for k, (i, x, y) in enumerate(rows):
        for j, p, q in rows[:k]:
            if i is None or j is None or i == j or None in (x, y, p, q):
                continue
            d = math.sqrt((x - p) * (x - p) + (y - q) * (y - q))
            if 0 < d <= radius:
                out[math.floor(math.log2(d))] += 1
    return out


@pytest.mark.parametrize("part", [7, 1 << 16])
def test_counts_equal_loops(spark, monkeypatch, part):
    """A grid with distances that are powers of two, clumps, and points of no position; with small parts several meet in a tile."""
    monkeypatch.setattr(octaves, "PART", part)
    rng = np.random.default_rng(8)
    grid = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-40, 40, (120, 2)) * rng.choice([0.5, 1.0, 4.0], (120, 1)))]
    clump = [(1000 + i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(16, 0.01, (120, 2)))]
    wide = [(2000 + i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-100, 100, (120, 2)))]
    near = [(3000, 8.0, 8.0), (3001, 8.0 + math.nextafter(1, 0), 8.0), (3002, 8.0, 8.0 + 1e-170), (3003, 0.0, 1e-160)]
    odd = [(5, 1.0, 1.0), (5, 2.0, 2.0), (5, 2.0, 2.0), (None, 1.0, 1.0), (4000, None, 1.0)]
    rows = grid + clump + wide + near + odd
    lost = [(4001, math.nan, 1.0), (4002, math.inf, 1.0)]
    got = octaves.pair_counts(spark.createDataFrame(rows + lost, SCHEMA), 8.0).collect()
    assert {r.bin: r.dd for r in got} == serial(rows, 8.0)


def test_no_row_for_each_pair(spark, monkeypatch):
    """Three million equal points at two places are two spots; the correlation function counts the same way."""
    monkeypatch.setattr(linking, "plane_pairs", lambda a, b, r, pairs=linking.plane_pairs: pairs(a.limit(10), b, r))
    rows = spark.range(3_000_000).selectExpr("id", "100D + (id % 2) * 3D AS x", "100D AS y")
    assert [tuple(r) for r in octaves.pair_counts(rows, 32.0).collect()] == [(1, 1_500_000**2)]
    got = linking.correlation_function(rows, 200.0, 32.0).filter("bin = 1").collect()
    assert [r.dd for r in got] == [1_500_000**2]


def test_empty(spark):
    assert octaves.pair_counts(spark.createDataFrame([], SCHEMA), 8.0).count() == 0
