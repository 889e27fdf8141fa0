"""Matching against brute force: the RA seam, the poles, ties and serial greedy order."""

import numpy as np
import pandas as pd
import pytest

from meridian.operators import match
from meridian.operators.rounds import components


def sep(a, b):
    r1, d1, r2, d2 = np.radians([a[0], a[1], b[0], b[1]])
    x = np.hypot(np.cos(d2) * np.sin(r2 - r1), np.cos(d1) * np.sin(d2) - np.sin(d1) * np.cos(d2) * np.cos(r2 - r1))
    return 3600 * np.degrees(np.arctan2(x, np.sin(d1) * np.sin(d2) + np.cos(d1) * np.cos(d2) * np.cos(r2 - r1)))


@pytest.mark.parametrize("centre", [(359.9999, 0.0), (10.0, 89.9995), (200.0, -89.9995), (150.0, 45.0)])
def test_sky_pairs_equal_brute_force(spark, centre):
    rng = np.random.default_rng(3)
    spread = 0.002 / max(np.cos(np.radians(centre[1])), 1e-5)
    ra, dec = (centre[0] + rng.uniform(-min(spread, 180), min(spread, 180), 60)) % 360, np.clip(centre[1] + rng.uniform(-0.002, 0.002, 60), -90, 90)
    df = spark.createDataFrame(pd.DataFrame({"id": range(60), "ra": ra, "dec": dec}))
    got = {(r.a_id, r.b_id) for r in match.sky_pairs(df, df, 2.0).collect()}
    assert got == {(i, j) for i in range(60) for j in range(60) if sep((ra[i], dec[i]), (ra[j], dec[j])) <= 2.0}


def test_one_to_one_is_serial_greedy(spark):
    rng = np.random.default_rng(5)
    pairs = pd.DataFrame({"a_id": np.repeat(range(12), 6), "b_id": rng.integers(0, 9, 72), "sep": rng.uniform(0, 1, 72)}).drop_duplicates(["a_id", "b_id"])
    free, want = set(range(9)), set()
    for a in pairs.groupby("a_id").sep.min().sort_values().index:
        for r in pairs[pairs.a_id == a].sort_values("sep").itertuples():
            if r.b_id in free:
                free.discard(r.b_id)
                want.add((a, r.b_id))
                break
    assert {(r.a_id, r.b_id) for r in match.one_to_one(spark.createDataFrame(pairs)).collect()} == want


def test_suppression_is_serial_greedy(spark):
    rng = np.random.default_rng(7)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 30, (60, 2)).tolist() if p[0] != p[1]}
    kept = []
    for i in range(30):  # smaller id wins
        if not any((k, i) in pairs for k in kept):
            kept.append(i)
    rows = spark.createDataFrame([(i,) for i in range(30)], "id long")
    got = match.suppress(rows, spark.createDataFrame(sorted(pairs), "winner long, loser long"))
    assert sorted(r.id for r in got.collect()) == kept


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5)], "a long, b long")
    assert {r.id: r.component for r in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 5: 5}


def test_empty_pairs(spark):
    none = spark.createDataFrame([], "id long, ra double, dec double")
    assert match.nearest(match.sky_pairs(none, none, 1.0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_best_of_kinds_is_serial_greedy(spark, seed):
    """Kinds of many rows with few distinct scores, so that equal ones connect kinds, some of which wait for better pairs."""
    rng = np.random.default_rng(seed)
    kinds = {n: rng.integers(0, 8, 70) for n in "ab"}
    score = {(i, j): float(rng.integers(1, 5)) for i in range(8) for j in range(8) if rng.random() < 0.5}
    pairs = sorted((-score[p], i, j) for i, x in enumerate(kinds["a"]) for j, y in enumerate(kinds["b"]) if (p := (int(x), int(y))) in score)
    used, want = (set(), set()), set()
    for s, i, j in pairs:
        if i not in used[0] and j not in used[1]:
            used[0].add(i)
            used[1].add(j)
            want.add((i, j, -s))
    a, b = (spark.createDataFrame([(i, int(k)) for i, k in enumerate(kinds[n])], "id long, kind long") for n in "ab")
    got = match.best_of_kinds(a, b, spark.createDataFrame([(*p, s) for p, s in score.items()], "a long, b long, score double"), "score")
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_equal_boxes_meet_as_classes(spark):
    """Four places of a thousand equal boxes each: a million pairs a place, of which the operators see four."""
    rows = spark.range(4000).selectExpr("id", "0L AS frame_id", "20D * (id % 4) AS x_min", "0D AS y_min", "20D * (id % 4) + 10 AS x_max", "10D AS y_max", "(1 + pmod(xxhash64(id), 1000)) / 1000D AS score")
    soft = {r.id: r for r in match.soft_suppress_boxes(rows, 16.0).collect()}
    scores = {r.id: r.score for r in rows.collect()}
    for k in range(4):
        work, taken = {i: scores[i] for i in range(k, 4000, 4)}, set()
        while max((w for i, w in work.items() if i not in taken), default=0) >= 0.05:
            top = max((w, -i) for i, w in work.items() if i not in taken)
            taken.add(-top[1])
            work = {i: w if i in taken else w * np.exp(-2.0) for i, w in work.items()}
        assert {i for i in work if soft[i].taken} == taken
        assert all(abs(soft[i].score - w) < 1e-12 for i, w in work.items())
    pairs = match.greedy_overlaps(rows, rows, 16.0, 0.5).collect()
    assert len(pairs) == 4000 and all(r.a_id == r.b_id and r.iou == 1 for r in pairs)
