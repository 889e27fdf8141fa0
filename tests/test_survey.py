"""Operators without SQL against planted truth or brute force on small tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meridian.operators import learn, linking, photoz, pixels, profiles, spectra
from meridian.operators import population as N
from meridian.sources import tables


def frame_rows(grid, epoch=0):
    return [(epoch, int(y), int(x), float(v), 2.0) for (y, x), v in np.ndenumerate(grid)]


def test_average_precision_equals_serial(spark):
    rng = np.random.default_rng(3)
    score = rng.integers(0, 40, 200) / 40
    matched = rng.random(200) < 0.4
    predicted = spark.createDataFrame(pd.DataFrame({"id": np.arange(200), "score": score}))
    hits = spark.createDataFrame(pd.DataFrame({"id": np.flatnonzero(matched)}))
    order = np.lexsort((np.arange(200), -score))
    tp = np.cumsum(matched[order])
    precision = np.maximum.accumulate((tp / np.arange(1, 201))[::-1])[::-1]
    expected = precision[matched[order]].sum() / 100
    for block in (7, 100_000):
        assert N.average_precision(predicted, hits, 100, block).first()[0] == pytest.approx(expected)
    assert N.average_precision(predicted, hits.limit(0), 100).first()[0] == 0


def test_emission_redshift_finds_planted_lines(spark):
    w = 3600 + 5.0 * np.arange(900)
    noise = np.random.default_rng(1).normal(0, 0.02, len(w))
    rows = []
    for key, z, lines in ((1, 0.12, spectra.EMISSION.values()), (2, 0.0, [6562.8]), (3, 0.0, [])):
        flux = noise + sum((np.exp(-0.5 * ((w - line * (1 + z)) / 6) ** 2) for line in lines), np.zeros(len(w)))
        rows += [(key, float(a), float(b)) for a, b in zip(w, flux, strict=True)]
    rows += [(4, 4000.0, 1.0), (5, None, None)]
    got = {r["spec_id"]: r for r in spectra.emission_redshift(spark.createDataFrame(rows, "spec_id long, wavelength double, excess double")).collect()}
    assert got[1]["z"] == pytest.approx(0.12, abs=5e-4) and got[1]["n_lines"] >= 4
    assert all(got[k]["z"] is None or np.isnan(got[k]["z"]) or got[k]["n_lines"] >= 2 for k in (2, 3))
    assert got[4]["n_lines"] == 0 and got[5]["n_lines"] == 0


def test_aperture_flux_takes_the_sky_off(spark):
    yy, xx = np.mgrid[0:30, 0:30]
    grid = np.full((30, 30), 7.0) + np.where((yy == 15) & (xx == 14), 100.0, 0.0)
    pixels = spark.createDataFrame(frame_rows(grid), "epoch long, y int, x int, value double, rms double")
    sources = spark.createDataFrame([(1, 0, 14.0, 15.0), (2, 9, 14.0, 15.0)], "source_id long, epoch long, sx double, sy double")
    rows = profiles.aperture_fluxes(sources, pixels, "epoch", 3.0, 5.0, 9.0).collect()
    assert [r["source_id"] for r in rows] == [1]
    assert rows[0]["flux"] == pytest.approx(100.0) and rows[0]["flux_err"] == pytest.approx(2 * np.sqrt(_squares(3.0)), rel=0.2)


def _squares(radius):
    return np.pi * radius**2


def test_growth_radii_of_a_gaussian(spark):
    yy, xx = np.mgrid[0:61, 0:61]
    grid = np.exp(-0.5 * ((yy - 30) ** 2 + (xx - 30) ** 2) / 5.0**2)
    pixels = spark.createDataFrame(frame_rows(grid) + frame_rows(np.zeros((61, 61)), 1), "epoch long, y int, x int, value double, rms double")
    got = {r["epoch"]: r for r in profiles.concentration(pixels, "epoch", 30, 30, 29.0).collect()}
    assert got[0]["r50"] == pytest.approx(5 * np.sqrt(2 * np.log(2)), abs=0.15)
    assert got[0]["concentration"] == pytest.approx(2.5 * np.log10(np.log(5) / np.log(1.25)), abs=0.1)
    assert got[1]["r50"] is None and got[1]["concentration"] is None
    radii = {r["epoch"]: r for r in profiles.adaptive_aperture(pixels, "epoch", 30, 30, 2.0, 25.0).collect()}
    assert radii[0]["radius"] == pytest.approx(2.5 * 5 * np.sqrt(np.pi / 2), rel=0.02) and radii[1]["radius"] == 2.0


def test_sersic_scan_recovers_index(spark):
    r = np.arange(0.5, 20.5)
    b = 2 * 2.1 - 1 / 3 + 4 / (405 * 2.1) + 46 / (25515 * 2.1**2) + 131 / (1148175 * 2.1**3)
    value = 9 * np.exp(-b * ((r / 4) ** (1 / 2.1) - 1))
    rows = [(1, float(a), float(v)) for a, v in zip(r, value, strict=True)] + [(2, float(a), float(a)) for a in r] + [(3, 1.0, 1.0)]
    got = {x["epoch"]: x for x in profiles.sersic_scan(spark.createDataFrame(rows, "epoch long, r double, value double"), "epoch").collect()}
    assert (got[1]["n"], got[1]["r_eff"], got[1]["amplitude"]) == pytest.approx((2.1, 4, 9), rel=1e-6)
    assert got[2]["n"] is None and got[3]["n"] is None


def test_colours_do_not_depend_on_scale(spark):
    w = np.arange(2000.0, 11000.0, 20.0)
    rows = [(k, float(a), float(s * (1 + a / 5000))) for k, s in ((1, 1.0), (2, 50.0)) for a in w]
    grid = photoz.colour_grid(spark.createDataFrame(rows, "template long, wavelength double, flux double"), [0.0, 0.3], ["g", "r", "i"]).orderBy("z", "template").toPandas()
    assert np.allclose(grid["g_r"][0::2], grid["g_r"][1::2]) and (grid["g_r"] > 0).all() and grid["g_r"][0] > grid["g_r"][2]


def test_linear_probe_separates_classes(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), (rng.normal(0, 0.3, 4) + 3 * np.eye(4)[k]).tolist()) for k in rng.integers(0, 3, 300)]
    data = spark.createDataFrame(rows, "label int, x array<double>")
    got = learn.linear_probe(data.limit(200), data).toPandas()
    assert len(got) == 3 and (got["accuracy"] > 0.98).all() and got["n"].sum() == 300


def test_survey_planes_of_missing_rows(spark):
    science = spark.createDataFrame([(0, 0, 0, 5.0), (0, 0, 1, None), (0, 0, 2, 300.0)], "epoch long, y int, x int, value double")
    variance = spark.createDataFrame([(0, 0, 0, 4.0), (0, 0, 2, -1.0)], "epoch long, y int, x int, noise double")
    got = {r["x"]: (r["bad"], r["sigma"]) for r in tables.survey_planes(science, ["epoch", "y", "x"], None, variance, "variance", None, 300.0).collect()}
    assert got == {0: (False, 2.0), 1: (True, 0.0 if got[1][1] == 0 else None), 2: (True, 0.0)}
    with pytest.raises(ValueError):
        tables.survey_planes(science, ["epoch"], kind="gain")


def test_tiles_give_the_same_as_the_whole(spark):
    grid = np.random.default_rng(2).random((23, 31))
    pixels = spark.createDataFrame(frame_rows(grid), "epoch long, y int, x int, value double, rms double")

    def doubled(part):
        return part.assign(value=part["value"] * 2)[["epoch", "y", "x", "value"]]

    got = profiles.per_tile(pixels, "epoch", 7, 3, doubled, "epoch long, y int, x int, value double")
    assert got.count() == grid.size and got.agg(F.sum("value")).first()[0] == pytest.approx(2 * grid.sum())


def test_hold_one_out_equals_median_of_the_others(spark):
    rng = np.random.default_rng(8)
    rows = [(e, 0, x, float(rng.integers(0, 4)), 1.0) for x, n in ((0, 1), (1, 2), (2, 5), (3, 6)) for e in range(n)]
    got = pixels.hold_one_out(spark.createDataFrame(rows, "epoch long, y int, x int, value double, rms double")).collect()
    assert len(got) == len(rows)
    for r in got:
        others = [v for e, _, x, v, _ in rows if x == r["x"] and e != r["epoch"]]
        assert r["residual"] == (r["value"] - np.median(others) if others else None)


def test_azimuthal_span_of_repeats_and_one_angle(spark):
    rows = [(1, 10.0), (1, 10.0), (1, 10.02), (1, 200.0), (2, 5.0), (3, None)]
    got = {r["k"]: r["span"] for r in linking.azimuthal_span(spark.createDataFrame(rows, "k int, angle double"), "k").collect()}
    assert got == {1: pytest.approx(360 - 189.98), 2: pytest.approx(0.0)}
