"""Stellar locus and growth curves: planted truths and serial versions; exact quantiles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.operators import growth, locus, quantiles


def test_quantiles_of_groups(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=101), "b": np.repeat(3.0, 7), "c": np.array([5.0]), "d": rng.choice([1.0, 2.0], 40)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("e", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.share): r.value for r in quantiles.group_quantiles(df, ["g"], "v", shares).collect()}
    assert got.keys() == {(g, s) for g in groups for s in shares}
    assert all(abs(got[g, s] - np.quantile(xs, s)) < 1e-12 for g, xs in groups.items() for s in shares)
    middle, mad = quantiles.median_and_mad(df.filter("g = 'a'"), "v")
    assert abs(middle - np.median(groups["a"])) < 1e-12 and abs(mad - 1.4826 * np.median(np.abs(groups["a"] - middle))) < 1e-12
    assert math.isnan(quantiles.quantiles(df.filter("g = 'e'"), "v", [0.5])[0])


def field(rng, stars=90, galaxies=70):
    """Stars along a cubic with small scatter, galaxies about it with more, some without a stellarity."""
    x = rng.uniform(0.2, 1.6, stars + galaxies)
    y = 0.1 + 0.5 * x - 0.3 * x**2 + 0.2 * x**3 + np.r_[rng.normal(0, 0.02, stars), rng.normal(0, 0.25, galaxies)]
    stellarity = np.r_[rng.uniform(0.6, 1, stars), rng.uniform(0, 0.35, galaxies)]
    return x, y, stellarity, 10 ** rng.uniform(0.8, 2.5, stars + galaxies)


def serial_locus(x, y, stellarity, snr):
    px, py = x[stellarity >= 0.6], y[stellarity >= 0.6]
    keep, c = np.ones(len(px), bool), np.polyfit(px, py, 3)
    for _ in range(4):
        r = py - np.polyval(c, px)
        spread = 1.4826 * np.median(np.abs(r[keep] - np.median(r[keep])))
        new = np.abs(r) <= 2.5 * spread
        if (new == keep).all():
            break
        keep = new
        c = np.polyfit(px[keep], py[keep], 3)
    low, high = px[keep].min(), px[keep].max()
    grid = np.linspace(low - 0.15 * (high - low), high + 0.15 * (high - low), 128)
    d = np.hypot(grid - x[:, None], np.polyval(c, grid) - y[:, None]).min(axis=1)
    star, galaxy, key = stellarity >= 0.6, stellarity <= 0.3, np.log10(snr)

    def width(v):
        v = v[v <= np.percentile(v, 90)] if len(v) >= 5 else v
        return np.sqrt((v**2).mean() / 2)

    edges = np.percentile(key[star], [0, 100 / 3, 200 / 3, 100])
    edges[0] -= 1e-6
    widths = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        s, g = (d[m & (key > a) & (key <= b)] for m in (star, galaxy))
        widths.append(((a + b) / 2, width(s), max(width(g) if len(g) >= 6 else width(d[galaxy]), width(s))))
    centres, sw, gw = map(np.array, zip(*widths, strict=True))
    out = np.full(len(x), np.nan)
    for i in np.flatnonzero(key >= centres[0] - 0.25):
        s = np.interp(key[i], centres, sw)
        g = max(np.interp(key[i], centres, gw), s)

        def ray(w):
            return d[i] / w**2 * np.exp(-0.5 * (d[i] / w) ** 2)  # noqa: B023

        a, b = (0.95 * ray(w) + 0.05 * ray(4 * g) for w in (s, g))
        out[i] = np.clip(a / (a + b), 0.08, 0.92)
    s, g = out[star & ~np.isnan(out)], out[galaxy & ~np.isnan(out)]
    return c, keep.sum(), (low, high), d, widths, out, np.mean((s[:, None] > g) + 0.5 * (s[:, None] == g))


def test_locus_equals_serial(spark):
    x, y, stellarity, snr = field(np.random.default_rng(2))
    rows = [(i, float(a), float(b), float(s), float(n)) for i, (a, b, s, n) in enumerate(zip(x, y, stellarity, snr, strict=True))]
    df = spark.createDataFrame([*rows, (900, None, 1.0, 0.9, 5.0), (901, 0.5, 0.5, None, 20.0)], "id long, x double, y double, stellarity double, snr double")
    told = df.filter("stellarity IS NOT NULL")
    got = locus.calibrate(told, locus.fit_locus(told))
    c, n, ends, d, widths, scores, auc = serial_locus(x, y, stellarity, snr)
    assert np.allclose(got.coefficients, c, atol=1e-6) and got.n_stars == n and np.allclose((got.low, got.high), ends)
    assert np.allclose(list(zip(got.centres, got.star_width, got.galaxy_width, strict=True)), widths, atol=1e-7)
    assert abs(got.separation - auc) < 1e-6 and got.informative and got.weight > 0.5 and got.n_galaxies == (stellarity <= 0.3).sum()
    scored = df.select("id", got.distance(F.col("x"), F.col("y")).alias("d"), got.stellarity(F.col("x"), F.col("y"), F.col("snr")).alias("s")).collect()
    scored = {r.id: r for r in scored}
    assert all(abs(scored[i].d - d[i]) < 1e-6 for i in range(len(x)))
    assert all((scored[i].s is None) == bool(np.isnan(scores[i])) and (scored[i].s is None or abs(scored[i].s - scores[i]) < 1e-5) for i in range(len(x)))
    assert scored[900].d is None and scored[900].s is None
    assert locus.fit_locus(told.limit(5)) is None


def test_locus_without_information(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(0.3 * a + rng.normal(0, 0.05)), 0.9 if i % 2 else 0.1, 30.0 + i) for i, a in enumerate(rng.uniform(0, 1, 80))]
    df = spark.createDataFrame(rows, "id long, x double, y double, stellarity double, snr double")
    got = locus.calibrate(df, locus.fit_locus(df, degree=1))
    assert got.weight < 0.35
    none = locus.Locus([0.3, 0.0], 0.0, 1.0)
    assert not none.informative and none.weight == 0 and df.select(none.stellarity(F.col("x"), F.col("y"), F.col("snr")).alias("s")).first().s == 0.5


def test_growth_curve_reads_off_a_planted_wing(spark):
    """Curves 1 - 0.3 r^-1.2 over their value at the last radius: the median comes back and so does the light beyond."""
    rng, radii = np.random.default_rng(4), np.linspace(1, 25, 40)
    true = 1 - 0.3 * radii**-1.2
    rows = [(0, s, 100.0 - s, k, float(r), float(v)) for s in range(9) for k, (r, v) in enumerate(zip(radii, true / true[-1] * (1 + (s - 4) * 1e-4), strict=True))]
    rows += [(1, s, 10.0, k, float(r), 1.0) for s in range(4) for k, r in enumerate(radii)]  # too few stars
    rows += [(0, 99, 1.0, k, float(r), float(rng.random())) for k, r in enumerate(radii)]  # fainter than the most stars taken
    df = spark.createDataFrame(rows, "frame long, star long, snr double, k int, radius double, share double")
    got = growth.growth_curve(df, "frame", most=9).toPandas().sort_values("radius")
    assert set(got.frame) == {0} and (got.n_stars == 9).all() and np.allclose(got.radius, radii)
    enclosed = true / true[-1]
    outer = np.arange(40) >= 26
    good = outer & (1 - enclosed > 1e-4)
    slope, start = np.polyfit(np.log(radii[good]), np.log(1 - enclosed[good]), 1)
    missing = np.clip(math.exp(start) * radii[-1] ** slope, 0, 0.08)
    assert abs(got.missing_beyond.iloc[0] - missing) < 1e-6 and 0 < missing < 0.08
    assert np.allclose(got.enclosed, enclosed * (1 - missing), atol=1e-6) and np.allclose(got.scatter, 1.4826 * 2e-4 * enclosed * (1 - missing), atol=1e-6)


def test_star_curves_equal_serial(spark):
    rng = np.random.default_rng(5)
    stars = [(0, 1, 20.3, 21.7, 90.0), (0, 2, 45.0, 44.5, 80.0), (1, 3, 30.0, 30.0, 70.0), (0, 4, 2.0, 2.0, 60.0)]
    pixels, image = [], {}
    for f in (0, 1):
        yy, xx = np.mgrid[:64, :64]
        image[f] = 5 + rng.normal(0, 0.01, (64, 64))
        for _, _, x, y, flux in (s for s in stars if s[0] == f):
            image[f] += flux * np.exp(-0.5 * ((xx - x) ** 2 + (yy - y) ** 2) / 4)
        pixels += [(f, int(x), int(y), float(image[f][y, x])) for y in range(64) for x in range(64)]
    got = growth.star_curves(spark.createDataFrame(stars, "frame long, star long, x double, y double, snr double"), spark.createDataFrame(pixels, "frame long, x int, y int, value double"), "frame", 10.0, steps=12).toPandas()
    yy, xx = np.mgrid[:64, :64]
    for f, star, sx, sy, _ in stars:
        r = np.hypot(xx - sx, yy - sy)
        sky = np.median(image[f][(r >= 12) & (r <= 18)])
        light = []
        for radius in np.linspace(1, 10, 12):
            share = np.zeros((64, 64))
            for u in (np.arange(5) + 0.5) / 5 - 0.5:
                for w in (np.arange(5) + 0.5) / 5 - 0.5:
                    share += (np.hypot(xx + u - sx, yy + w - sy) <= radius + 1e-9) / 25
            light.append(((image[f] - sky) * share)[r <= 11].sum())
        mine = got[got.star == star].sort_values("k").share.to_numpy()
        assert np.allclose(mine, np.array(light) / light[-1], atol=1e-6), star


@pytest.mark.parametrize("frames", [[], [(0, 1, 1.0, 1.0, 5.0)]])
def test_no_stars(spark, frames):
    stars = spark.createDataFrame(frames, "frame long, star long, x double, y double, snr double")
    pixels = spark.createDataFrame([], "frame long, x int, y int, value double")
    assert growth.growth_curve(growth.star_curves(stars, pixels, "frame", 5.0), "frame").count() == 0
