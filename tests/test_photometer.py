"""Catalog photometry of planted Gaussian sources."""

import math

import numpy as np

from meridian.operators import photometer


def test_planted_sources(spark):
    rng, s = np.random.default_rng(1), 2.0
    planted = {1: (30.3, 31.8, 8000.0), 2: (90.0, 35.5, 900.0), 3: (60.0, 90.0, 3.0), 4: (95.0, 95.0, -2500.0)}
    yy, xx = np.mgrid[:128, :128]
    image = 50 + rng.normal(0, 1.5, (128, 128))
    for x, y, f in planted.values():
        image += f / (2 * math.pi * s * s) * np.exp(-0.5 * ((xx - x) ** 2 + (yy - y) ** 2) / s**2)
    pixels = spark.createDataFrame([(0, int(y), int(x), float(image[y, x]), 1.5) for y in range(128) for x in range(128)], "frame long, y int, x int, value double, rms double")
    sources = spark.createDataFrame([(i, 0, x, y, s, 20) for i, (x, y, _) in planted.items()], "source_id long, frame long, sx double, sy double, semi_major double, area_pixels int")
    got = {r.source_id: r for r in photometer.measure(sources, pixels, "frame").collect()}
    assert set(got) == set(planted)
    for i in (1, 2):
        r, f = got[i], planted[i][2]
        assert abs(r.background - 50) < 0.5
        for radius in (2, 3, 5, 8):
            want = f * (1 - math.exp(-0.5 * (radius / s) ** 2))
            assert abs(r[f"flux_{radius}"] - want) < 0.02 * f + 40
        assert abs(r.flux - f * (1 - math.exp(-0.5 * (r.aperture_radius / s) ** 2))) < 4 * r.flux_err and r.flags == []
        assert abs(r.magnitude - (25 - 2.5 * math.log10(r.flux))) < 1e-9 and abs(r.surface_brightness - (25 - 2.5 * math.log10(r.flux / 20))) < 1e-9
    r = got[1]
    assert abs(r.r50 - s * math.sqrt(2 * math.log(2))) < 0.15 and abs(r.r90 - s * math.sqrt(2 * math.log(10))) < 0.4
    assert abs(r.concentration - 5 * math.log10(math.sqrt(math.log(5) / math.log(1.25)))) < 0.25
    assert abs(r.aperture_radius - 2.5 * r.kron_radius) < 1e-9 and 1 / 1.5 < r.kron_radius / (s * math.sqrt(math.pi / 2)) < 1.5
    assert "low_snr" in got[3].flags
    assert set(got[4].flags) >= {"negative_flux", "low_snr"} and got[4].magnitude is None

    curve = spark.createDataFrame([(0, float(r), 1 - math.exp(-0.5 * (r / 2.5) ** 2)) for r in np.linspace(1, 20, 60)], "frame long, radius double, enclosed double")
    fixed = {r.source_id: r for r in photometer.measure(sources, pixels, "frame", curve).collect()}
    for i in (1, 2):
        share = np.interp(fixed[i].aperture_radius, np.linspace(1, 20, 60), 1 - np.exp(-0.5 * (np.linspace(1, 20, 60) / 2.5) ** 2))
        assert abs(fixed[i].aperture_correction - 1 / share) < 1e-9 and abs(fixed[i].flux - got[i].flux / share) < 1e-6 and abs(fixed[i].snr - got[i].snr) < 1e-9


def test_cells_give_what_pairs_give(spark):
    """Ring backgrounds and aperture fluxes of sources over several cells of a frame equal those from rows of sources and pixels, which no plan makes."""
    from pyspark.sql import functions as F

    from meridian.operators import frames as R
    from meridian.operators import pixels as P
    from meridian.operators import profiles

    rng = np.random.default_rng(4)
    values = rng.exponential(20, (70, 90)).round(1)
    values[:20, :20] = 3.0
    rows = [(1, y, x, None if rng.random() < 0.02 else float(values[y, x]), float(rng.uniform(1, 5))) for y in range(70) for x in range(90)]
    pixels = spark.createDataFrame(rows, "frame long, y int, x int, value double, rms double")
    at = [(i, 1, float(rng.uniform(-5, 95)), float(rng.uniform(-5, 75))) for i in range(60)] + [(60, 2, 5.0, 5.0), (61, 1, 500.0, 5.0), (62, 1, None, 5.0), (63, 1, 10.0, 10.0)]
    sources = spark.createDataFrame(at, "source_id long, frame long, sx double, sy double")
    r = F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))
    good = pixels.filter("value IS NOT NULL")
    ring = R.near_pixels(sources, good, "frame", 9.0).filter((r >= 5) & (r < 9))
    want = {s.source_id: s for s in P.clipped_statistics(ring, ["source_id", "frame"]).collect() if s.kept >= 5}
    sky = R.annulus_background(sources, pixels, "frame", 5.0, 9.0)
    assert "Window" not in sky._jdf.queryExecution().executedPlan().toString()
    got = {s.source_id: s for s in sky.collect()}
    assert got.keys() == set(range(64)) and len(want) > 50
    for i, s in got.items():
        w = want.get(i)
        assert (s.n, s.level) == ((w.kept, w.median) if w else (0, 0.0)) and abs(s.rms - (w.std if w else 0.0)) < 1e-9
    near = R.near_pixels(sources, good, "frame", 4.0).withColumn("w", P.coverage(3.0)).filter("w > 0")
    sums = {s.source_id: s for s in near.groupBy("source_id").agg(F.sum(F.col("w") * F.col("value")).alias("flux"), F.sum("w").alias("area")).collect()}
    fluxes = {s.source_id: s for s in profiles.aperture_fluxes(sources, pixels, "frame", 3.0, 5.0, 9.0).collect()}
    assert fluxes.keys() == sums.keys()
    for i, s in fluxes.items():
        assert abs(s.area - sums[i].area) < 1e-9 and abs(s.flux - (sums[i].flux - sums[i].area * got[i].level)) < 1e-9
