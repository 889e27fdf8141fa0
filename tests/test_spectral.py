"""Redshifts, dispersions, line fluxes and line votes: planted truths and serial versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.operators import lines as L
from meridian.operators import redshift as Z

ABSORBED = [("Ca K", 8, 5), ("Ca H", 7, 5), ("G band", 4, 6), ("H beta", 3, 5), ("Mg b", 6, 6), ("Na D", 5, 5)]


def gauss(w, centre, sigma):
    return np.exp(-0.5 * ((w - centre) / sigma) ** 2)


def galaxy(w, z=0.0, emission=0.0, width=0.0):
    """Absorption of an old population at redshift z; widths in Angstrom grow by a velocity."""
    flux = np.full(len(w), 100.0) + 0.002 * (w - 5000)
    for name, depth, sigma in ABSORBED:
        c = L.LINES[name] * (1 + z)
        wide = math.hypot(sigma * (1 + z), c * width / Z.LIGHT)
        flux -= 4.0 * depth * sigma * (1 + z) / wide * gauss(w, c, wide)
    for name in ("[O II]", "H beta", "[O III] 5007", "H alpha", "[N II] 6584"):
        flux += emission * gauss(w, L.LINES[name] * (1 + z), 4.0)
    return flux


def rows(spec_id, w, flux, error, rng):
    noise = rng.normal(0, error, len(w))
    return [(spec_id, i, float(x), float(f + n), float(error)) for i, (x, f, n) in enumerate(zip(w, flux, noise, strict=True))]


SPECTRUM = "spec_id long, pix long, wavelength double, flux double, error double"
REST = np.arange(3300.0, 8200.0, 3.0)


@pytest.fixture(scope="module")
def templates(spark):
    rng = np.random.default_rng(0)
    star = 100 - 60 * sum(gauss(REST, c, 9) for c in (4102, 4340, 4861, 6563)) - 45 * sum(gauss(REST, c, 12) for c in (3650, 5270, 7100))
    out = [("old", "galaxy", *r[1:]) for r in rows(0, REST, galaxy(REST), 0.01, rng)] + [("hot", "star", *r[1:]) for r in rows(0, REST, star, 0.01, rng)]
    return spark.createDataFrame(out, "template string, kind string, pix long, wavelength double, flux double, error double")


def test_redshifts_of_planted_spectra(spark, templates):
    rng, w = np.random.default_rng(1), np.arange(3800.0, 8000.0, 3.0)
    truth = {1: 0.05, 2: 0.21, 3: 0.38}
    table = [r for s, z in truth.items() for r in rows(s, w, galaxy(w, z), 2.0, rng)]
    table += rows(4, w, np.full(len(w), 100.0), 5.0, rng) + rows(5, w[:80], galaxy(w[:80]), 1.0, rng) + rows(6, w, np.full(len(w), 100.0) + galaxy(w, 0.1, 60) - galaxy(w, 0.1), 3.0, rng)
    star = 100 - 60 * sum(gauss(w, c * (1 + 300 / Z.LIGHT), 9) for c in (4102, 4340, 4861, 6563)) - 45 * sum(gauss(w, c, 12) for c in (5270, 7100))
    table += rows(7, w, star, 2.0, rng)
    got = {r.spec_id: r for r in Z.redshifts(spark.createDataFrame(table, SPECTRUM), templates, (-0.005, 0.6)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7}
    for s, z in truth.items():
        assert abs(got[s].z - z) < 0.001 and got[s].reliable and got[s].template == "old" and not got[s].is_star and got[s].z_error > 0, got[s]
    assert not got[4].reliable and "low_correlation" in got[4].flags
    assert got[5].flags == ["too_few_pixels"] and got[5].z is None
    assert abs(got[6].z_emission - 0.1) < 0.001 and got[6].n_emission_lines >= 2
    assert got[7].is_star and abs(got[7].z) < 0.003


def test_every_lag_is_searched():
    """The correlation equals sums over all overlaps; R equals the definition."""
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=90), rng.normal(size=(2, 90))
    c = Z.correlate(a, b)
    for t in range(2):
        want = [sum(a[i] * b[t, i - lag] for i in range(90) if 0 <= i - lag < 90) for lag in range(-89, 90)]
        assert np.allclose(c[t], np.array(want) / math.sqrt((a**2).sum() * (b[t] ** 2).sum()))
    p = 100
    odd = [0.5 * (c[0, p + k] - c[0, p - k]) for k in range(1, min(p, 178 - p) + 1)]
    assert abs(Z.antisymmetric_r(c[0], p) - c[0, p] / (math.sqrt(2) * math.sqrt(np.mean(np.square(odd))))) < 1e-9
    assert math.isnan(Z.antisymmetric_r(c[0], 3)) and math.isnan(Z.antisymmetric_r(np.zeros(99), 50))


def test_dispersions(spark, templates):
    rng, w, truth = np.random.default_rng(3), np.arange(3800.0, 8000.0, 3.0), {1: 200.0, 2: 300.0, 3: 0.0}
    table = [r for s, v in truth.items() for r in rows(s, w, galaxy(w, 0.1, 0.0, v), 0.2, rng)]
    known = spark.createDataFrame([(s, 0.1) for s in truth] + [(9, None)], "spec_id long, z double")
    got = {r.spec_id: r for r in Z.dispersions(spark.createDataFrame(table, SPECTRUM), known, templates.filter("template = 'old'").drop("template", "kind")).collect()}
    assert set(got) == set(truth)
    for s in (1, 2):
        assert abs(got[s].fitted_width - truth[s]) <= 40 and got[s].reliable and abs(got[s].sigma**2 - (got[s].fitted_width**2 - got[s].instrumental**2)) < 1e-6
    assert got[3].fitted_width <= 60 and not got[3].reliable and got[3].sigma is None


def serial_fit(w, residual, centres, velocities=(30.0, 600.0), resolution=5.0, half=None, absorbed=False):
    best = None
    window = np.abs(w - np.mean(centres)) < half
    for v in np.linspace(*velocities, 28):
        sigmas = [math.hypot(resolution / 2.3548, c * v / Z.LIGHT) for c in centres]
        columns = [gauss(w[window], c, s) for c, s in zip(centres, sigmas, strict=True)]
        if absorbed:
            columns.append(gauss(w[window], centres[0], math.hypot(resolution / 2.3548, centres[0] * 350 / Z.LIGHT)))
        a = np.stack(columns, axis=1)
        x = np.linalg.lstsq(a, residual[window], rcond=None)[0]
        chi2 = ((residual[window] - a @ x) ** 2).sum()
        if best is None or chi2 < best[0]:
            best = (chi2, x, sigmas, np.sqrt(np.diag(np.linalg.inv(a.T @ a))))
    return best


def test_line_fluxes_of_planted_blends(spark):
    rng, w, z = np.random.default_rng(4), np.arange(4600.0, 7400.0, 2.0), 0.05
    planted = {"H alpha": 80.0, "[N II] 6584": 30.0, "[N II] 6548": 10.0, "[O III] 5007": 60.0, "[O III] 4959": 20.0, "H beta": 25.0}
    sigma = {n: math.hypot(5 / 2.3548, L.LINES[n] * (1 + z) * 120 / Z.LIGHT) for n in planted}
    flux = np.full(len(w), 50.0)
    for n, a in planted.items():
        flux += a * gauss(w, L.LINES[n] * (1 + z), sigma[n])
    table = rows(1, w, flux, 1.0, rng)
    spectra = spark.createDataFrame(table, SPECTRUM).withColumn("continuum", F.lit(50.0))
    known = spark.createDataFrame([(1, z), (2, 0.1), (3, None)], "spec_id long, z double")
    got = {r.name: r for r in L.fit_lines(spectra, known).filter("spec_id = 1").collect()}
    assert set(got) == set(L.LINES)
    for n, a in planted.items():
        true = a * sigma[n] * math.sqrt(2 * math.pi)
        assert abs(got[n].flux - true) < 5 * got[n].flux_error and got[n].detected and abs(got[n].equivalent_width - got[n].flux / got[n].continuum) < 1e-9, (n, got[n], true)
    assert "blended" in got["H alpha"].flags and got["[O II]"].flags == ["outside_the_spectrum"] and got["[O II]"].flux is None
    assert "not_detected" in got["Na D"].flags and abs(got["Na D"].upper_limit - 3 * got["Na D"].flux_error) < 1e-9
    residual = np.array([r[3] for r in table]) - 50
    names = ["[N II] 6548", "H alpha", "[N II] 6584"]
    centres = [L.LINES[n] * (1 + z) for n in names]
    _, x, sigmas, errors = serial_fit(w, residual, centres, half=20 + centres[-1] - centres[0])
    for n, a, s, e in zip(names, x, sigmas, errors, strict=True):
        assert abs(got[n].flux - a * s * math.sqrt(2 * math.pi)) < 1e-5 * abs(got[n].flux) and abs(got[n].sigma - s) < 1e-9
        assert 0.7 < got[n].flux_error / (e * s * math.sqrt(2 * math.pi)) < 1.4
    _, x, sigmas, _ = serial_fit(w, residual, [L.LINES["H beta"] * (1 + z)], half=20, absorbed=True)
    assert abs(got["H beta"].flux - x[0] * sigmas[0] * math.sqrt(2 * math.pi)) < 1e-4 * abs(got["H beta"].flux)
    assert ("stellar_absorption_corrected" in got["H beta"].flags) == (x[1] < 0)


def test_wide_line_is_at_the_limit(spark):
    w = np.arange(5600.0, 6200.0, 2.0)
    table = rows(1, w, 50 + 40 * gauss(w, L.LINES["Na D"], 30.0), 0.5, np.random.default_rng(5))
    got = L.fit_lines(spark.createDataFrame(table, SPECTRUM).withColumn("continuum", F.lit(50.0)), spark.createDataFrame([(1, 0.0)], "spec_id long, z double"), ["Na D"]).first()
    assert got.flags == ["width_at_search_limit", "not_detected"] and not got.detected


def test_votes_equal_loops(spark):
    rng, catalog = np.random.default_rng(6), sorted([4046.6, 4358.3, 5460.7, 5769.6, 5790.7, 4916.0, 6234.4])
    table = {s: np.sort((rng.choice(catalog, 5, replace=False) - 3900) / (2.5 + s) + rng.normal(0, 0.2, 5)) for s in range(4)}
    table[9] = np.array([5.0])
    got = {r.spec_id: r for r in L.vote_linear(spark.createDataFrame([(s, float(p)) for s, ps in table.items() for p in ps], "spec_id long, centre double"), catalog).collect()}
    assert set(got) == {0, 1, 2, 3}
    for s in got:
        ps, best = table[s], (0, math.inf, None)
        for i in range(len(ps)):
            for j in range(i + 1, len(ps)):
                for a in range(len(catalog)):
                    for b in range(a + 1, len(catalog)):
                        scale = (catalog[b] - catalog[a]) / (ps[j] - ps[i])
                        if ps[j] - ps[i] >= 0.15 * (ps[-1] - ps[0]) and 0.2 <= scale <= 40:
                            d = np.abs(scale * ps[:, None] + catalog[a] - scale * ps[i] - np.array(catalog)).min(axis=1)
                            score = (-(d < 6).sum(), round(d[d < 6].sum(), 9), scale)
                            if best[2] is None or score[:2] < best[:2]:
                                best = score
        assert (got[s].hits, got[s].scale) == (-best[0], pytest.approx(best[2])) and got[s].hits == 5
        assert abs(got[s].scale - (2.5 + s)) < 0.05
