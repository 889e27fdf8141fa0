"""Queries of the catalog store: fields streamed one after another, then what the store holds."""

from pyspark.sql import functions as F

from ..operators.rounds import shared_folder
from ..streaming.store import Store
from .queries_scalar import sep_sql
from .registry import query

_STORES: dict[tuple[str, str], Store] = {}


def _store(v) -> Store:
    """The detections streamed field by field, once a session and folder: one file a field, without the true identities."""
    key = (v.spark.sparkContext.applicationId, v.sf_dir)
    if key not in _STORES:
        folder = shared_folder(v.spark)
        rows = v.detections.select("detection_id", "field_id", "mjd", "band", "ra", "dec", "flux", "flux_err")
        rows.repartition(64, "field_id").write.parquet(f"{folder}/in")  # a given number is not coalesced
        store = Store(v.spark, f"{folder}/store")
        store.ingest_stream(v.spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), f"{folder}/log")
        _STORES[key] = store
    return _STORES[key]


#: True identities: of a true object, the first field's detections found one object each, the nearest of which takes each later detection.
_LINKED = f"""WITH f AS (SELECT field_id, row_number() OVER (ORDER BY min(mjd), field_id) AS k FROM detections GROUP BY field_id),
d AS (SELECT detections.*, k, min(k) OVER (PARTITION BY object_truth) AS first_k FROM detections JOIN f USING (field_id)),
p AS (SELECT d.detection_id, o.detection_id AS object_id, row_number() OVER (PARTITION BY d.detection_id ORDER BY round(3600 * {sep_sql('d.ra', 'd.dec', 'o.ra', 'o.dec')}, 9), o.detection_id) AS r FROM d JOIN d o ON d.object_truth = o.object_truth AND o.k = o.first_k AND d.k > d.first_k),
linked AS (SELECT d.*, coalesce(p.object_id, d.detection_id) AS object_id FROM d LEFT JOIN p ON p.detection_id = d.detection_id AND r = 1)"""


@query("str01_field_ingest", "detections", _LINKED + " SELECT CAST(field_id AS BIGINT) AS field_id, k AS number, count(*) AS n_detections, count(*) AS n_with_sky, count(*) FILTER (object_id <> detection_id) AS n_matched, count(*) FILTER (object_id = detection_id) AS n_new_objects, CAST(0 AS BIGINT) AS n_wrong FROM linked GROUP BY ALL")
def _(v):
    """The report of every field of the stream; the truth only counts the links to another object's founder."""
    store = _store(v)
    truth = v.detections.select("detection_id", "object_truth")
    links = store.detections().select("detection_id", "object_id", "field_id").join(truth, "detection_id")
    founder = truth.select(F.col("detection_id").alias("object_id"), F.col("object_truth").alias("founder_truth"))
    wrong = links.join(founder, "object_id").groupBy("field_id").agg(F.count(F.when(F.col("object_truth") != F.col("founder_truth"), 1)).alias("n_wrong"))
    return store.fields().select("field_id", "number", "n_detections", "n_with_sky", "n_matched", "n_new_objects").join(wrong, "field_id")


@query("src13_store_links", "detections", _LINKED + " SELECT detection_id, object_id, field_id FROM linked")
def _(v):
    return _store(v).detections().select("detection_id", "object_id", F.col("field_id").cast("int").alias("field_id"))


@query("src14_store_objects", "detections", _LINKED + """, b AS (SELECT object_id, band, min(k) AS k, count(*) AS n, min(mjd) AS lo, max(mjd) AS hi FROM linked GROUP BY ALL)
SELECT b.object_id, o.ra, o.dec, CAST(sum(n) AS BIGINT) AS n_detections, min(lo) AS first_mjd, max(hi) AS last_mjd, string_agg(b.band, ',' ORDER BY b.k, b.band) AS bands, CAST(o.field_id AS BIGINT) AS founded_by
FROM b JOIN linked o ON o.detection_id = b.object_id GROUP BY ALL""", "ra dec first_mjd last_mjd")  # fmt: skip
def _(v):
    return _store(v).objects().drop("healpix")


@query("src14_object_history", "detections", _LINKED + ", m AS (SELECT object_id FROM linked GROUP BY object_id ORDER BY count(*) DESC, object_id LIMIT 1) SELECT detection_id, mjd, band, flux, 'field ' || field_id AS field_name FROM linked WHERE object_id = (SELECT object_id FROM m)", "mjd flux")
def _(v):
    """The history of the object that was seen most often."""
    store = _store(v)
    most = store.objects_with_history(2, 1).first().object_id
    return store.history(most).select("detection_id", "mjd", "band", "flux", "field_name")


@query("join02_store_cone", "detections", f"SELECT * FROM (SELECT detection_id, 3600 * {sep_sql('ra', 'dec', '150.1', '2.02')} AS separation_arcsec FROM detections) WHERE separation_arcsec <= 60", "separation_arcsec")
def _(v):
    return _store(v).cone(150.1, 2.02, 60).select("detection_id", "separation_arcsec")
