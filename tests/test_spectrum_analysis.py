"""Supernova types and the whole analysis on planted spectra."""

import numpy as np
import pytest

from meridian.operators import spectrum_analysis as A

from test_spectral import REST, SPECTRUM, galaxy, gauss, rows, templates  # noqa: F401

TYPES = {("Ia", 0.0): [(3950, 60), (5450, 70), (6150, 60)], ("Ia", 20.0): [(4300, 80), (5000, 60), (6200, 90)], ("II", 10.0): [(4860, 60), (6560, 110), (5050, 50)], ("Ic", 5.0): [(4450, 120), (5700, 90), (7700, 110)]}


def supernova(w, dips, z=0.0):
    return 100 - sum(50 * gauss(w, c * (1 + z), s * (1 + z)) for c, s in dips)


def test_planted_types(spark):
    rng, w = np.random.default_rng(1), np.arange(3800.0, 8500.0, 4.0)
    library = [(t, p, *r[1:]) for (t, p), dips in TYPES.items() for r in rows(0, REST, supernova(REST, dips), 0.05, rng)]
    library = spark.createDataFrame(library, "type string, phase double, pix long, wavelength double, flux double, error double")
    table, hosts = [], []
    for s, ((kind, phase), dips) in enumerate(TYPES.items()):
        table += rows(s, w, supernova(w, dips, 0.05), 1.5, rng) + rows(10 + s, w, supernova(w, dips, 0.12), 1.5, rng)
        hosts += [(s, 0.05), (10 + s, None)]
    table += rows(20, w, np.full(len(w), 100.0), 4.0, rng) + rows(21, w[:50], np.full(50, 100.0), 4.0, rng)
    got = {r.spec_id: r for r in A.classify_supernovae(spark.createDataFrame(table, SPECTRUM), spark.createDataFrame(hosts, "spec_id long, z double"), library).collect()}
    assert len(got) == 10
    for s, (kind, phase) in enumerate(TYPES):
        r = got[s]
        assert (r.sn_type, r.phase, r.redshift) == (kind, phase, 0.05) and r.confident and r.margin >= 2 and r.runner_up != kind, r
        assert got[10 + s].sn_type is None or got[10 + s].sn_type == kind and abs(got[10 + s].redshift - 0.12) < 0.01
    assert sum(got[10 + s].confident for s in range(4)) >= 2
    assert not got[20].confident and got[20].sn_type is None and got[21].reason == "too few usable pixels"


def test_nothing_is_measured_without_a_redshift(spark, templates):  # noqa: F811
    rng, w = np.random.default_rng(2), np.arange(3900.0, 8100.0, 3.0)
    star = 100 - 60 * sum(gauss(w, c, 9) for c in (4102, 4340, 4861, 6563)) - 45 * sum(gauss(w, c, 12) for c in (5270, 7100))
    table = rows(1, w, galaxy(w, 0.08, 45), 1.0, rng) + rows(2, w, star, 1.0, rng) + rows(3, w, np.full(len(w), 100.0), 5.0, rng) + rows(4, w, galaxy(w, 0.3), 25.0, rng)
    spectra = spark.createDataFrame(table, SPECTRUM)
    known = spark.createDataFrame([(4, 0.3)], "spec_id long, z double")
    got = {r.spec_id: r for r in A.analyse(spectra, templates, known, early="old", z_range=(-0.005, 0.5)).collect()}
    assert abs(got[1].z_used - 0.08) < 0.002 and got[1].stopped_at is None and got[1].n_detected >= 4 and got[1].region != "unclassified" and got[1].ebv is not None
    assert got[1].log_o3_hb == pytest.approx(0, abs=0.15) and got[1].log_n2_ha == pytest.approx(0, abs=0.15)  # all lines were planted alike
    assert got[2].stopped_at == "identified as a star" and got[2].n_detected is None and got[2].sigma is None
    assert got[3].stopped_at == "redshift not reliable" and got[3].z_used is None
    assert got[4].z_used == 0.3 and got[4].stopped_at is None and got[4].n_detected is not None
