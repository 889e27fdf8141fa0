"""Learning operators against what is known of small inputs."""

import inspect

from meridian.operators import learn, lightcurve
from meridian.plans import registry


def test_dbscan_joins_dense_clumps(spark):
    """Two clumps of 80 copies within eps are one cluster, though each row has 79 nearer neighbours in its own clump."""
    rows = spark.createDataFrame([(i, [0.0 if i < 80 else 0.5, 0.0]) for i in range(160)] + [(200, [5.0, 5.0])], "vec_id long, x array<double>")
    got = {r.vec_id: r.cluster for r in learn.dbscan(rows, "vec_id", 0.9, 4).collect()}
    assert got == {i: 0 for i in range(160)} | {200: -1}


def test_period_queries_use_all_trial_frequencies(spark, monkeypatch):
    """The registered searches run over the default 2000 frequencies and 128 trees."""
    seen, periods = [], lightcurve.periods

    def spy(*args, **kwargs):
        bound = inspect.signature(periods).bind(*args, **kwargs)
        bound.apply_defaults()
        seen.append(bound.arguments["n_frequencies"])
        return periods(*args, **kwargs)

    monkeypatch.setattr(lightcurve, "periods", spy)
    registry.load()
    for name in ("model16_periods", "model30_variability_search"):
        registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == [2000, 2000]
    assert inspect.signature(learn.isolation_forest).parameters["trees"].default == 128
