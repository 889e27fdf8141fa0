"""The transient search on planted frames, and each step against a serial version."""

import math

import numpy as np
from pyspark.sql import functions as F

from meridian.operators import rules, transients

SCHEMA = "epoch long, y int, x int, value double, rms double, bad boolean"


def frames(rng, size=64):
    """Six epochs of stars with one transient in epochs 2 to 4, one cosmic ray, one bad pixel and a fainter second epoch."""
    yy, xx = np.mgrid[:size, :size]
    blob = lambda y, x, f: f * np.exp(-0.5 * ((xx - x) ** 2 + (yy - y) ** 2) / (3 / 2.3548) ** 2)
    sky = sum(blob(*p, 900) for p in ((10, 12), (50, 20), (30, 55), (15, 45), (52, 50)))
    out = []
    for e in range(6):
        image = sky * (0.8 if e == 1 else 1.0) + rng.normal(0, 2, (size, size))
        if 2 <= e <= 4:
            image += blob(32.3, 28.6, 60 + 10 * e)
        if e == 3:
            image[20, 30] += 300
            image[45, 40] += 400
        bad = np.zeros_like(image, bool)
        bad[45, 40] = e == 3
        out += [(e, y, x, float(image[y, x]), 2.0, bool(bad[y, x])) for y in range(size) for x in range(size)]
    return out


def test_planted_transient_is_found_once(spark):
    rows = spark.createDataFrame(frames(np.random.default_rng(1)), SCHEMA)
    every = transients.epoch_candidates(rows).toPandas()
    near = every[np.hypot(every.x - 28.6, every.y - 32.3) < 1.5]
    assert near.epoch.tolist() and set(near.epoch) == {2, 3, 4} and len(near) == 3 and not near.bogus.any() and (near.real_bogus > 0.8).all()
    assert not ((np.hypot(every.x - 40, every.y - 45) < 2).any())  # the bad pixel
    real = every[~every.bogus]
    assert len(real) == 3, real
    found = transients.search(rows).toPandas().sort_values("rank")
    top = found.iloc[0]
    assert top.n_epochs == 3 and top.multi_epoch and not top.bogus and top.verdict in ("high_priority", "follow_up_recommended") and math.hypot(top.x - 28.6, top.y - 32.3) < 0.5
    assert len(found[(~found.bogus)]) == 1 and (found["rank"].to_numpy() == np.arange(1, len(found) + 1)).all()


def test_differences_equal_serial(spark):
    table = frames(np.random.default_rng(2))
    cube, usable = np.array([r[3] for r in table]).reshape(6, 64, 64), ~np.array([r[5] for r in table]).reshape(6, 64, 64)
    got = transients.differences(spark.createDataFrame(table, SCHEMA)).toPandas().sort_values(["epoch", "y", "x"])
    for e in range(6):
        template = np.median(np.delete(cube, e, 0), axis=0)
        level = np.minimum(cube[e], template) / 2
        scale = 1.0
        for s, least in ((10, 25), (3, 10)):
            on = usable[e] & (level > s)
            if on.sum() >= least:
                scale = (cube[e][on] * template[on]).sum() / (template[on] ** 2).sum()
                break
        mine = got[got.epoch == e]
        assert np.allclose(mine.difference, (cube[e] - np.clip(scale, 0.05, 20) * template).ravel(), atol=1e-8)
        assert np.allclose(mine.noise, 2 * math.sqrt(1 + np.clip(scale, 0.05, 20) ** 2 / 5))


def test_psf_correlation(spark):
    yy, xx = np.mgrid[:11, :11]
    star = np.exp(-0.5 * ((xx - 5) ** 2 + (yy - 5) ** 2) / (3 / 2.3548) ** 2)
    stamps = {1: 50 * star + 1, 2: np.where((xx == 5) & (yy == 5), 90.0, 0.0), 3: np.ones((11, 11)), 4: np.roll(star, 4, 1)}
    rows = [(k, int(y), int(x), float(v[y, x])) for k, v in stamps.items() for y in range(11) for x in range(11)]
    got = {r.k: r for r in rules.real_bogus(rules.stamp_features(spark.createDataFrame(rows, "k long, y int, x int, value double"), "k", 1.0)).collect()}
    assert abs(got[1].psf_correlation - 1) < 1e-9 and got[3].psf_correlation is None
    for k in (2, 4):
        assert abs(got[k].psf_correlation - np.corrcoef(stamps[k].ravel(), star.ravel())[0, 1]) < 1e-9
    assert got[1].real_bogus > got[2].real_bogus and got[2].worst in ("cosmic_ray", "not_point_like") and got[4].real_bogus < 0.7


def test_no_pixels(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert transients.search(none).count() == 0
    flat = spark.range(3 * 400).select((F.col("id") / 400).cast("long").alias("epoch"), ((F.col("id") % 400) / 20).cast("int").alias("y"), (F.col("id") % 20).cast("int").alias("x"), F.lit(5.0).alias("value"), F.lit(1.0).alias("rms"), F.lit(False).alias("bad"))
    assert transients.search(flat).count() == 0
