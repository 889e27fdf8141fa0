"""The catalog store against a serial loop, across the seam and the poles, and under failures and repeats."""

import numpy as np
import pandas as pd
import pytest

from meridian.operators.rounds import shared_folder
from meridian.streaming import store as store_module
from meridian.streaming.store import Store

from test_match import sep


def fields(rng, centre, n=25, epochs=3, spread=0.003):
    """Detections of n objects (some close pairs) in several fields; a few have no position."""
    wide = spread / max(np.cos(np.radians(centre[1])), 1e-5)
    ra, dec = centre[0] + rng.uniform(-min(wide, 180), min(wide, 180), n), np.clip(centre[1] + rng.uniform(-spread, spread, n), -90, 90)
    rows = []
    for e in range(epochs):
        for k in np.flatnonzero(rng.random(n) < 0.8):
            jitter = rng.normal(0, 0.4 / 3600, 2)
            at = ((ra[k] + jitter[0] / max(np.cos(np.radians(dec[k])), 1e-5)) % 360, float(np.clip(dec[k] + jitter[1], -90, 90)))
            rows.append((len(rows) + 1, e + 10, 60000.0 + e, "gr"[e % 2], *(at if rng.random() < 0.95 else (None, float("nan"))), float(rng.uniform(1, 9)), float("inf") if k == 0 else 0.5))
    return pd.DataFrame(rows, columns=["detection_id", "field_id", "mjd", "band", "ra", "dec", "flux", "flux_err"])


def serial(table, radius=1.5):
    objects, links = {}, {}
    for _, part in table.groupby("field_id"):
        new = {}
        for r in part.itertuples():
            if r.ra is None or np.isnan(r.ra) or np.isnan(r.dec):
                links[r.detection_id] = None
                continue
            near = sorted((round(s, 9), o) for o, at in objects.items() if (s := sep((r.ra, r.dec), at)) <= radius)
            links[r.detection_id] = near[0][1] if near else r.detection_id
            if not near:
                new[r.detection_id] = (r.ra, r.dec)
        objects |= new
    return links


@pytest.mark.parametrize("centre", [(359.9995, 0.0), (10.0, 89.9995), (45.0, -41.81)])
def test_links_equal_a_serial_loop(spark, centre):
    table = fields(np.random.default_rng(5), centre)
    store = Store(spark, shared_folder(spark))
    store.ingest_batch(spark.createDataFrame(table))
    want = serial(table)
    assert {r.detection_id: r.object_id for r in store.detections().collect()} == want
    assert len({o for o in want.values() if o}) < len(table) / 2
    n = store.counts().first()
    assert (n.fields, n.detections, n.objects) == (3, len(table), len({o for o in want.values() if o}))
    got = {r.object_id: r for r in store.objects().collect()}
    for o, r in got.items():
        mine = table[table.detection_id.map(want.get) == o]
        assert (r.n_detections, r.first_mjd, r.last_mjd) == (len(mine), mine.mjd.min(), mine.mjd.max())
        assert r.bands == ",".join(dict.fromkeys(mine.band)) and r.founded_by == mine.field_id.iloc[0]
    brute = sorted((round(s, 6), r.detection_id) for r in table.itertuples() if r.ra is not None and not np.isnan(r.dec) and (s := sep((r.ra, r.dec), centre)) <= 5)
    assert sorted((round(r.separation_arcsec, 6), r.detection_id) for r in store.cone(*centre, 5).collect()) == brute


def test_failed_and_repeated_ingests_change_nothing(spark, monkeypatch):
    table = fields(np.random.default_rng(6), (150.0, 2.0), epochs=3)
    rows, store = spark.createDataFrame(table), Store(spark, shared_folder(spark))

    def fails(self, row):
        raise RuntimeError("lost")

    commit = Store._commit
    store.ingest(rows.filter("field_id = 10"), 10)
    before = sorted(store.detections().collect())
    monkeypatch.setattr(Store, "_commit", fails)
    with pytest.raises(RuntimeError):
        store.ingest(rows.filter("field_id = 11"), 11)
    monkeypatch.setattr(Store, "_commit", commit)
    assert sorted(store.detections().collect()) == before and store.fields().count() == 1
    assert store.ingest(rows.filter("field_id = 10"), 10) is None
    store.ingest_batch(rows)
    store.ingest_batch(rows)
    assert {r.detection_id: r.object_id for r in store.detections().collect()} == serial(table)
    assert store.founders().count() == store.counts().first().objects and store.fields().count() == 3


def test_stream_and_odd_fields(spark, monkeypatch):
    """Files streamed one a batch give what one batch gives; a field without positions, an empty field, and no association."""
    table = fields(np.random.default_rng(7), (20.0, -5.0), epochs=3)
    folder = shared_folder(spark)
    rows = spark.createDataFrame(table)
    rows.coalesce(1).write.partitionBy("field_id").parquet(f"{folder}/in")
    for f in (10, 11, 12):
        rows.filter(f"field_id = {f}").coalesce(1).write.mode("append").parquet(f"{folder}/files")
    monkeypatch.setattr(store_module, "MOST_FOLDERS", 0)  # the founders of the whole sky
    store = Store(spark, f"{folder}/store")
    store.ingest_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/files"), f"{folder}/log")
    assert {r.detection_id: r.object_id for r in store.detections().collect()} == serial(table)
    assert [r.number for r in store.fields().orderBy("field_id").collect()] == [1, 2, 3]
    flat = spark.createDataFrame([(900, None, float("nan"), 5.0)], "detection_id long, ra double, dec double, flux double")
    report = store.ingest(flat, 50, mjd=1.0, band="z", name="plate", manifest={"key": "a"})
    assert (report["n_detections"], report["n_with_sky"], report["n_new_objects"], report["band"]) == (1, 0, 0, "z")
    row = store.field_rows(50).first()
    assert row.object_id is None and row.dec is None and row.healpix is None and row.flux == 5.0
    assert store.ingest(flat.limit(0), 51)["n_detections"] == 0
    again = spark.createDataFrame([(901, 20.0, -5.0)], "detection_id long, ra double, dec double")
    assert store.ingest(again, 52, associate=False)["n_matched"] == 0
    first = table[table.detection_id.map(serial(table).get) == 1]
    assert [r.mjd for r in store.history(1).collect()] == first.mjd.tolist()
    assert [r.flux for r in store.light_curve(1, "g").collect()] == first[first.band == "g"].flux.tolist()
    assert Store(spark, f"{folder}/none").fields().count() == 0


def test_equal_distances_go_as_in_sql(spark):
    """Founders at equal distance by symmetry: the SQL's ninth decimals decide, even where the engines' sines differ in their last bit."""
    import duckdb

    from meridian.operators.match import nearest, sky_pairs
    from meridian.plans.queries_scalar import sep_sql

    rng = np.random.default_rng(9)
    ra, dec = 150 + rng.integers(0, 40, 4000) * 0.01, 2 + rng.integers(0, 2200, 4000) * 0.01
    a = pd.DataFrame({"id": np.arange(4000), "ra": ra, "dec": dec})
    b = pd.DataFrame({"id": np.arange(4000) + 4000, "ra": ra + rng.integers(-6, 7, 4000) * 0.00002, "dec": dec + rng.integers(-4, 5, 4000) * 0.00002})
    want = {(r[0], r[1]): r[2] for r in duckdb.sql(f"SELECT a.id, b.id, 3600 * {sep_sql('a.ra', 'a.dec', 'b.ra', 'b.dec')} FROM a JOIN b ON abs(a.ra - b.ra) < 0.001 AND abs(a.dec - b.dec) < 0.001").fetchall()}
    left, right = spark.createDataFrame(a), spark.createDataFrame(b)
    got = {(r.a_id, r.b_id): r.sep for r in sky_pairs(left, right, 1.5, settled=True).collect()}
    doubtful = {k for k, v in want.items() if v <= 1.5 and abs(v * 1e9 % 1 - 0.5) < 0.05}
    assert len(doubtful) > 100 and got.keys() == {k for k, v in want.items() if v <= 1.5}
    assert all(got[k] == want[k] for k in doubtful)
    plain = {(r.a_id, r.b_id): r.sep for r in sky_pairs(left, right, 1.5).collect()}
    assert max(abs(plain[k] - want[k]) for k in plain) < 5e-11
    links = {r.a_id: r.b_id for r in nearest(sky_pairs(left, right, 1.5, settled=True)).collect()}
    best = {}
    for (i, j), v in want.items():
        if v <= 1.5:
            best[i] = min(best.get(i, (9, 0)), (round(v, 9), j))
    assert links == {i: j for i, (_, j) in best.items()}
