"""Views F1 to F11 over the driver's tables, as the same SQL text for Spark and DuckDB."""

from __future__ import annotations

import re
from pathlib import Path
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPARK_MJD = "CAST(40587 AS DOUBLE) + unix_micros(CAST(ts AS TIMESTAMP)) / CAST(86400000000 AS DOUBLE)"
DUCKDB_MJD = "CAST(40587 AS DOUBLE) + epoch_us(ts) / CAST(86400000000 AS DOUBLE)"


def _load() -> dict[str, str]:
    """SQL of each view, read from its section of FIXTURES.md beside the package."""
    text = (Path(__file__).resolve().parents[2] / "FIXTURES.md").read_text()
    return {m[1]: m[2].strip() for m in re.finditer(r"^### F\d+ `(\w+)`.*?```sql\n(.*?)```", text, re.S | re.M)}


VIEWS = _load()
TABLES = {
    "detections": ["events"], "sources": ["orders"], "pixels": ["events"], "embeddings": ["embeddings"], "spectra": ["events"],
    "scored_labels": ["documents", "labels"], "verdicts": ["events"], "boxes": ["orders"], "epoch_detections": ["supplier"],
    "reference_objects": ["customer"],
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a lazy plan over the Parquet files; filters and columns reach the scan."""
    sql = VIEWS[name].replace("{MJD}", SPARK_MJD)
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]}
    for t in TABLES[name]:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **frames)


def views(spark: SparkSession, sf_dir: str) -> SimpleNamespace:
    """Attribute access to every view, built when first asked for."""

    class Lazy(SimpleNamespace):
        def __getattr__(self, name):
            if name.startswith("_"):
                raise AttributeError(name)
            found = alerts(self) if name == "alerts" else view(spark, sf_dir, name)
            setattr(self, name, found)
            return found

    return Lazy(spark=spark, sf_dir=sf_dir)


def alerts(v) -> DataFrame:
    """one nested packet per object, the newest detection as candidate and the earlier ones as history."""
    d = v.detections
    point = F.struct("mjd", "detection_id", "band", "ra", "dec", "flux", "flux_err")
    packed = d.groupBy("object_truth").agg(F.max(point).alias("top"), F.array_sort(F.collect_list(point)).alias("all"))
    top = F.col("top")
    candidate = F.struct(top["mjd"].alias("mjd"), top["band"].alias("band"), top["ra"].alias("ra"), top["dec"].alias("dec"), top["flux"].alias("flux"), top["flux_err"].alias("flux_err"), ((top["detection_id"] % 100) / 100.0).alias("rb"))
    past = F.slice("all", F.lit(1), F.greatest(F.size("all") - 1, F.lit(0)))
    history = F.transform(past, lambda p: F.struct(p["mjd"].alias("mjd"), p["band"].alias("band"), p["flux"].alias("flux"), p["flux_err"].alias("flux_err"), (p["detection_id"] % 10 == 0).alias("forced")))
    kind = F.when(F.col("object_truth") % 3 != 0, F.element_at(F.array(F.lit("sn"), F.lit("agn")), (F.col("object_truth") % 2 + 1).cast("int")))
    return packed.select(F.col("object_truth").cast("string").alias("object_id"), top["detection_id"].alias("candid"), candidate.alias("candidate"), history.alias("prv_candidates"), kind.alias("classification"))


ALERTS_SQL = """packed AS (SELECT object_truth, max(struct_pack(mjd := mjd, detection_id := detection_id, band := band, ra := ra, dec := dec, flux := flux, flux_err := flux_err)) AS top FROM detections GROUP BY object_truth),
alerts AS (SELECT CAST(object_truth AS VARCHAR) AS object_id, top.detection_id AS candid, top.mjd AS mjd, top.band AS band, top.ra AS ra, top.dec AS dec, top.flux AS flux, top.flux_err AS flux_err,
  (top.detection_id % 100) / 100.0 AS rb, CASE WHEN object_truth % 3 <> 0 THEN CASE WHEN object_truth % 2 = 0 THEN 'sn' ELSE 'agn' END END AS classification FROM packed),
history AS (SELECT CAST(d.object_truth AS VARCHAR) AS object_id, d.detection_id, d.mjd, d.band, d.flux, d.flux_err, d.detection_id % 10 = 0 AS forced FROM detections d JOIN alerts a ON CAST(d.object_truth AS VARCHAR) = a.object_id WHERE d.detection_id <> a.candid)"""


def duckdb_ctes(names: list[str]) -> str:
    """The views as common table expressions for DuckDB."""
    parts = [f"{n} AS ({VIEWS[n].replace('{MJD}', DUCKDB_MJD)})" for n in names if n not in ("alerts", "embeddings")]
    if "alerts" in names:
        if "detections" not in names:
            parts.append(f"detections AS ({VIEWS['detections'].replace('{MJD}', DUCKDB_MJD)})")
        parts.append(ALERTS_SQL)
    return ", ".join(parts)
