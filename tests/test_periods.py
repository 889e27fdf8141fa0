"""Period search against sums over all points and trial frequencies."""

import contextlib
import io

import numpy as np

from meridian.operators import lightcurve


def serial(t, y, e, n):
    """Frequency of the highest Lomb-Scargle power and that power, with the offset tau of each trial."""
    w = 1 / e**2 / (1 / e**2).sum()
    y, t = y - (w * y).sum(), t - t.min()
    low = max(1 / min(100.0, 2 * np.ptp(t)), 1 / (5 * np.ptp(t)))
    f = low + np.arange(n) * ((50 - low) / (n - 1))
    a = 2 * np.pi * f[:, None] * t
    half = 0.5 * np.arctan2((w * np.sin(2 * a)).sum(1), (w * np.cos(2 * a)).sum(1))[:, None]
    c, s = np.cos(a - half), np.sin(a - half)
    power = ((w * y * c).sum(1) ** 2 / (w * c * c).sum(1) + (w * y * s).sum(1) ** 2 / (w * s * s).sum(1)) / (w * y * y).sum()
    k = int(power.argmax())
    return k, power[k]


def test_periods_hold_no_point_times_frequency(spark):
    """Curves of several batches equal the plain sums, and the plan makes no row of a point and a frequency."""
    rng, rows, want = np.random.default_rng(3), [], {}
    for curve, size in ((1, 5), (2, 40), (3, 333)):
        t, e = 60000 + rng.uniform(0, 30, size), rng.uniform(0.5, 2, size)
        y = 50 + 8 * np.sin(2 * np.pi * t / (0.7 + curve)) + rng.normal(0, 1, size)
        rows += [(curve, *map(float, r)) for r in zip(t, y, e, strict=True)]
        want[curve] = serial(t, y, e, 500)
    rows += [(4, 60000.0 + i, 1.0, 1.0) for i in range(4)]  # too short
    rows += [(5, 60000.0 + i, 7.0, 1.0) for i in range(8)]  # constant, weights exact
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        found = lightcurve.periods(spark.createDataFrame(rows, "id long, mjd double, flux double, flux_err double"), "id", n_frequencies=500)
        plan = io.StringIO()
        with contextlib.redirect_stdout(plan):
            found.explain()
        assert "Generate" not in plan.getvalue()
        got = {r.id: r for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == {1, 2, 3, 5} and got[5].power == 0
    for curve, (k, power) in want.items():
        low = got[curve].frequency - k * (50 / 499)
        assert abs(got[curve].power - power) < 1e-9 and abs(low) < 50 / 499 * 1.5, (curve, low)
