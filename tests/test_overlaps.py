"""All pairs of overlapping boxes against loops, with many equal boxes."""

import numpy as np

from meridian.operators import match
from meridian.plans import registry

DATA = "/root/testdata/sf0.001"
registry.load()


def iou(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    area = sum((r[4] - r[2]) * (r[5] - r[3]) for r in (a, b))
    return w * h / (area - w * h) if w > 0 and h > 0 else 0.0


def test_every_overlapping_pair_is_named(spark, monkeypatch):
    """Lists of five ids, so that classes of equal boxes have several; flat boxes, boxes without a corner and without an id overlap nothing."""
    monkeypatch.setattr(match, "LISTED", 5)
    rng = np.random.default_rng(6)
    rows = [(i, int(f), float(x), float(y), float(x + w), float(y + 10)) for i, (f, x, y, w) in enumerate(zip(rng.integers(0, 2, 200), 4 * rng.integers(0, 8, 200), 5 * rng.integers(0, 2, 200), rng.choice([0, 8, 12], 200), strict=True))]
    odd = [(900, 0, None, 0.0, 8.0, 10.0), (None, 0, 0.0, 0.0, 8.0, 10.0), (901, None, 0.0, 0.0, 8.0, 10.0)]
    df = spark.createDataFrame(rows + odd, "id long, frame_id long, x_min double, y_min double, x_max double, y_max double")
    got = [tuple(r) for r in match.overlap_pairs(df, 16.0, 0.4).collect()]
    want = {(a[0], b[0], iou(a, b)) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and iou(a, b) > 0.4}
    assert set(got) == want and len(got) == len(want) > 500


def test_query_returns_pairs_with_their_overlap(spark):
    assert registry.QUERIES["join12_overlaps"](spark, DATA).columns == ["a_id", "b_id", "iou"]
