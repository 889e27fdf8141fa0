"""Regions on wide frames, and reproducible noise."""

from meridian.operators import pixels
from meridian.plans.queries_models import noise


def test_labels_on_wide_frames(spark):
    """(0, x = 1000) and (1, x = 0) are different pixels, and a corner joins only with eight neighbours."""
    rows = [(0, 0, 1000, 9.0), (0, 1, 0, 9.0), (0, 5, 5, 9.0), (0, 6, 6, 9.0), (1, 5, 5, 9.0), (0, 7, 7, 1.0)]
    df = spark.createDataFrame(rows, "epoch long, y int, x int, value double")
    got = pixels.label(df, "epoch", 5.0).groupBy("label").count().collect()
    assert sorted(r["count"] for r in got) == [1, 1, 1, 2]
    got = pixels.label(df, "epoch", 5.0, connectivity=4).groupBy("label").count().collect()
    assert sorted(r["count"] for r in got) == [1, 1, 1, 1, 1]


def test_noise_depends_on_keys_alone(spark):
    rows = spark.range(20_000)
    one = {r.id: r.e for r in rows.select("id", noise("id").alias("e")).collect()}
    two = {r.id: r.e for r in rows.repartition(7).select("id", noise("id").alias("e")).collect()}
    assert one == two
    mean = sum(one.values()) / len(one)
    assert abs(mean) < 0.05 and abs(sum(v * v for v in one.values()) / len(one) - 1) < 0.05
