"""Running medians against plain loops, and votes without a row for each candidate."""

import contextlib
import io

import numpy as np

from meridian.operators import lines, spectra


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def serial(flux, half, rounds, sigma=1.5):
    work = flux.copy()
    for _ in range(rounds):
        level = np.array([np.nanmedian(work[max(0, i - half) : i + half + 1]) for i in range(len(work))])
        spread = 1.4826 * np.nanmedian(np.abs(work - level))
        work = np.where(work - level > sigma * spread, level, work)
    return level


def test_continuum_equals_loops(spark):
    """Missing pixels are left out of their windows; no window of the plan gathers values."""
    rng, rows, want = np.random.default_rng(8), [], {}
    for s, size in ((1, 1), (2, 9), (3, 2500)):
        flux = np.round(rng.normal(20, 4, size), 1)
        flux[rng.random(size) < 0.1 if size > 1 else []] = np.nan
        rows += [(s, i, None if np.isnan(f) else float(f)) for i, f in enumerate(flux)]
        want |= {(s, i): c for i, c in enumerate(serial(flux, 6, 3))}
    rows += [(4, i, None) for i in range(5)]
    found = spectra.continuum(spark.createDataFrame(rows, "spec_id long, pix long, flux double"), 6, 3)
    assert "Window" not in plan_of(found)
    got = {(r.spec_id, r.pix): r.continuum for r in found.collect()}
    assert all(got[4, i] is None for i in range(5)) and len(got) == len(rows)
    assert all(abs(got[k] - c) < 1e-12 for k, c in want.items())


def test_votes_are_counted_in_the_row(spark):
    """No candidate of a pair of lines is a row of the plan, and small pieces give the same winner."""
    peaks = spark.createDataFrame([(s, float(p)) for s in (1, 2) for p in (3, 11, 20, 34, 50, 71, 90 + s)], "spec_id long, centre double")
    catalog = [4000.0 + 7 * p for p in (3, 11, 20, 34, 50, 71)]
    found = lines.vote_linear(peaks, catalog)
    assert plan_of(found).count("Generate") <= 2
    rows = found.collect()
    assert {(r.spec_id, r.hits, round(r.scale, 6), round(r.offset, 6)) for r in rows} == {(1, 6, 7.0, 4000.0), (2, 6, 7.0, 4000.0)}
