"""Queries of sources, sinks, alerts and streams: every one writes or streams what it reads back."""

import uuid

from pyspark.sql import functions as F

from ..operators.rounds import cut
from ..sources import tables as T
from ..streaming import jobs as S
from .registry import query


def _scratch(v):
    probe = cut(v.spark.range(1))  # its folder is the one the cluster shares
    return probe.inputFiles()[0].rsplit("/", 2)[0] + f"/io-{uuid.uuid4().hex}"


for _fmt, _id in (("csv", "src01"), ("json", "src02"), ("parquet", "src05"), ("orc", "src03")):

    def _round_trip(v, fmt=_fmt):
        rows, path = v.sources.select("source_id", "x", "y", "class", "flux", "area_pixels"), f"{_scratch(v)}.{fmt}"
        T.write_catalog(rows, path)
        return T.read_catalog(v.spark, path, rows.schema)

    query(f"{_id}_{_fmt}_round_trip", "sources", "SELECT source_id, x, y, class, flux, area_pixels FROM sources", "x y flux")(_round_trip)


@query("src06_alert_points", "alerts", "SELECT object_id, mjd, band, flux, flux_err, false AS forced FROM alerts UNION ALL SELECT object_id, mjd, band, flux, flux_err, forced FROM history", "mjd flux flux_err")
def _(v):
    return T.alert_points(v.alerts).drop("candid")


@query("src08_alert_schema")
def _(v):
    return T.schema_table(v.alerts)


@query("src20_alert_queue", "alerts", "SELECT a.object_id, a.candid, a.rb AS score, CAST(count(h.detection_id) AS INTEGER) AS n_history, CAST(count(*) FILTER (h.flux / h.flux_err >= 5) AS INTEGER) AS n_detections, CAST(count(*) FILTER (h.forced) AS INTEGER) AS n_forced FROM alerts a LEFT JOIN history h ON a.object_id = h.object_id GROUP BY a.object_id, a.candid, a.rb ORDER BY a.rb DESC, a.candid LIMIT 40", "score")
def _(v):
    return T.alert_queue(v.alerts, 40)


@query("str03_nightly_counts", "", "SELECT date_trunc('day', ts) AS night, event_type AS band, count(*) AS n, max(value) AS best FROM events GROUP BY ALL", "best")
def _(v):
    rows = v.spark.read.parquet(f"{v.sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("band"), F.col("value").alias("flux"))
    return S.nightly_counts(rows).select(F.col("window.start").cast("timestamp_ntz").alias("night"), "band", "n", "best")


@query("str04_object_state_stream", "detections", "SELECT object_truth AS object_id, CAST(count(*) AS BIGINT) AS n, min(mjd) AS first_mjd, max(mjd) AS last_mjd FROM detections GROUP BY object_truth", "first_mjd last_mjd")
def _(v):
    folder = _scratch(v)
    v.detections.select(F.col("object_truth").alias("object_id"), "mjd", "band").repartition(3).write.parquet(f"{folder}/in")
    schema = v.spark.read.parquet(f"{folder}/in").schema
    stream = v.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    done = []

    def merge(batch, before):
        new = S.object_state(batch)
        done.append(1)
        return new if before is None else S.merge_state(batch.sparkSession.read.parquet(before), new)

    S.run_to_table(stream, merge, f"{folder}/state", f"{folder}/log")
    return v.spark.read.parquet(f"{folder}/state/v{len(done) - 1}").drop("bands")


@query("str05_latest_verdicts", "verdicts", "SELECT source_id, label, reviewer, seq FROM verdicts QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, seq DESC) = 1")
def _(v):
    return S.latest_verdicts(v.verdicts)


