"""Registered queries against their SQL in DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from meridian.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
registry.load()
#: One query or two of each kind; the driver compares all of them at a larger size.
CHECKED = [
    "win01_variability_features", "win07_variability_class", "win08_phase_fold", "model30_most_variable", "sca01_magnitudes", "sca08_separation", "sca09_healpix",
    "sca12_distances", "prj03_renumber", "prj09_gated_colours", "join03_nearest_known", "join05_mutual_nearest", "join12_overlaps", "join15_catalog_comparison",
    "join19_enclosing_cone", "agg03_number_counts", "agg49_calibration_errors", "agg58_ranking_auc", "agg29_gini", "agg30_m20", "win12_stencil_mean", "model09_components", "top07_vetting_queue",
    "agg12_mode_estimate", "agg13_background", "agg19_flux_scale", "join20_calibration", "agg26_petrosian_radius", "agg36_phase_winding", "agg37_ring_completeness", "prj12_cutouts", "join09_hosts",
    "agg07_nearest_neighbours", "win17_sky_lines", "agg22_label_sizes", "agg32_concentration", "model18_colour_grid", "model25_sersic_scan", "agg55_annotate", "src17_survey_planes", "udf03_tiled_maxima",
    "agg56_silhouette", "model23_line_votes", "agg33_smoothness", "agg43_population_widths", "agg43_separation", "sca21_colour_stellarity", "agg34_psf_correlation", "join17_track_members",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), kind="stable").reset_index(drop=True)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    ours, theirs = rows(registry.QUERIES[name](spark, DATA).toPandas()), rows(duck.execute(registry.ORACLE[name]).df())
    assert list(ours.columns) == list(theirs.columns) and len(ours) == len(theirs)
    for c in ours.columns:
        a, b = ours[c], theirs[c]
        same = (a == b) | (a.isna() & b.isna())
        if a.dtype.kind == "f":
            same |= np.isclose(a.astype(float), b.astype(float), atol=2e-6)
        assert same.all(), (c, a[~same].head(3).tolist(), b[~same].head(3).tolist())


def test_magnitudes_of_no_light(spark, tmp_path):
    """Fluxes of 0 and below, and null, come back as the SQL has them."""
    folder = str(tmp_path)
    spark.sql("SELECT id AS event_id, id AS user_id, 'view' AS event_type, TIMESTAMP_NTZ'2020-01-02 03:04:05' AS ts, CASE id WHEN 0 THEN 0D WHEN 1 THEN -2D WHEN 2 THEN 2.5D END AS value FROM range(4)").write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    ours, theirs = (sorted(map(repr, x)) for x in ([tuple(r) for r in registry.QUERIES["sca01_magnitudes"](spark, folder).collect()], con.execute(registry.ORACLE["sca01_magnitudes"]).fetchall()))
    assert ours == theirs


def test_every_sql_has_a_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES)


def test_entry_module_imports():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
