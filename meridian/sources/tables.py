"""Readers and writers of catalogs, alerts, reference tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {"csv", "json", "parquet", "orc"}


def format_of(path: str, fmt: str | None = None) -> str:
    found = fmt or path.rstrip("/").rpartition(".")[2].lower()
    if found not in FORMATS:
        raise ValueError(f"unknown catalog format {found!r}")
    return found


def write_catalog(rows: DataFrame, path: str, fmt: str | None = None) -> None:
    """Format by extension or ``fmt``; arrays become text joined by a bar in CSV."""
    found = format_of(path, fmt)
    if found == "csv":
        rows = rows.withColumns({f.name: F.concat_ws("|", f.name) for f in rows.schema if f.dataType.typeName() == "array"})
        rows.write.csv(path, header=True)
    else:
        rows.write.format(found).save(path)


def read_catalog(spark: SparkSession, path: str, schema, fmt: str | None = None) -> DataFrame:
    """With a schema, never inferred; NaN and infinity become null on load."""
    found = format_of(path, fmt)
    rows = spark.read.schema(schema).option("header", True).csv(path) if found == "csv" else spark.read.schema(schema).format(found).load(path)
    doubles = [f.name for f in rows.schema if f.dataType.typeName() in ("double", "float")]
    return rows.withColumns({c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)) for c in doubles})


def schema_table(rows: DataFrame) -> DataFrame:
    """Field names and types without reading records."""
    return rows.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in rows.schema], "field string, type string")


def read_extract(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated catalog extract with comment, unit and dash lines: rows without a numeric position are dropped."""
    raw = spark.read.option("sep", "\t").option("comment", "#").option("header", True).csv(path)
    names = {c.lower(): c for c in raw.columns}
    ra = next(names[c] for c in ("raj2000", "_raj2000", "ra", "ra_icrs", "radeg") if c in names)
    dec = next(names[c] for c in ("dej2000", "_dej2000", "dec", "de_icrs", "dedeg") if c in names)
    mags = [c for c in raw.columns if c.lower().endswith("mag")]
    pairs = [x for c in mags for x in (F.lit(c), F.expr(f"try_cast(`{c}` AS DOUBLE)"))]
    magnitudes = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
    name = next((names[c] for c in ("name", "id", "source") if c in names), None)
    out = raw.select((F.col(name) if name else F.lit(None).cast("string")).alias("name"), F.expr(f"try_cast(`{ra}` AS DOUBLE)").alias("ra"), F.expr(f"try_cast(`{dec}` AS DOUBLE)").alias("dec"), F.map_filter(magnitudes, lambda _, m: m.isNotNull()).alias("magnitudes"))
    return out.filter("ra IS NOT NULL AND dec IS NOT NULL")


def newest_snapshot(snapshots: DataFrame, max_age_days: float, now: float) -> DataFrame:
    """Rows of the newest snapshot if it is young enough (column snapshot_mjd)."""
    top = snapshots.agg(F.max("snapshot_mjd").alias("top")).filter(F.col("top") >= now - max_age_days)
    return snapshots.join(F.broadcast(top), F.col("snapshot_mjd") == F.col("top")).drop("top")


def alert_points(alerts: DataFrame) -> DataFrame:
    """Candidate and history of nested packets as one row per point."""
    top = F.struct(*[F.col(f"candidate.{c}").alias(c) for c in ("mjd", "band", "flux", "flux_err")], F.lit(False).alias("forced"))
    return alerts.select("object_id", "candid", F.explode(F.concat(F.array(top), "prv_candidates")).alias("p")).select("object_id", "candid", "p.*")


def alert_queue(alerts: DataFrame, limit: int) -> DataFrame:
    """Alerts by real-bogus score (0.5 where missing), with the sizes of their histories."""
    score = F.coalesce("candidate.rb", F.lit(0.5))
    forced = F.size(F.filter("prv_candidates", lambda p: p["forced"]))
    found = F.size(F.filter("prv_candidates", lambda p: p["flux"] / p["flux_err"] >= 5))
    return alerts.select("object_id", "candid", score.alias("score"), F.size("prv_candidates").alias("n_history"), found.alias("n_detections"), forced.alias("n_forced")).orderBy(F.desc("score"), "candid").limit(limit)


#: Spellings of position and name columns in reference files.
RA_NAMES, DEC_NAMES, ID_NAMES = ("ra", "raj2000", "ra_deg", "ra_icrs"), ("dec", "dej2000", "dec_deg", "de_icrs"), ("name", "id", "source")


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """id, ra, dec, magnitudes (band to value) of a CSV file in any case of header; rows without a finite position are dropped."""
    raw = spark.read.option("header", True).csv(path)
    names = {c.lower(): c for c in raw.columns}

    def pick(spellings):
        return next(names[s] for s in spellings if s in names)

    def number(column):
        return F.expr(f"try_cast(`{column}` AS DOUBLE)")

    mags = [x for low, c in names.items() if low.endswith("mag") for x in (F.lit(low[: -len("mag")]), number(c))]
    magnitudes = F.map_filter(F.create_map(*mags), lambda _, m: m.isNotNull())
    out = raw.select(F.col(pick(ID_NAMES)).alias("id"), number(pick(RA_NAMES)).alias("ra"), number(pick(DEC_NAMES)).alias("dec"), magnitudes.alias("magnitudes"))
    limit = float("inf")
    return out.filter((F.abs("ra") < limit) & (F.abs("dec") < limit))


def append_verdicts(rows: DataFrame, path: str) -> int:
    """Append verdicts to a log; those without a reviewer are refused and counted."""
    signed = F.coalesce(F.trim("reviewer") != "", F.lit(False))
    rows.filter(signed).write.mode("append").parquet(path)
    return rows.filter(~signed).count()


def read_verdicts(spark: SparkSession, path: str, schema) -> DataFrame:
    """The whole log in the newest schema; what older rows lack is null."""
    return spark.read.schema(schema).parquet(path)


def write_alerts(alerts: DataFrame, path: str, least_rb: float):
    """Write the alerts that are not bogus; returns their schema."""
    kept = alerts.filter(F.coalesce("candidate.rb", F.lit(1.0)) >= least_rb)
    kept.write.parquet(path)
    return kept.schema


def report_rows(alerts: DataFrame, reporter: str) -> DataFrame:
    """Draft discovery reports of classified alerts, with the last non-detection before each; a reporter must be named."""
    if not reporter.strip():
        raise ValueError("a report needs a reporter")
    limits = F.filter("prv_candidates", lambda p: (p["flux"] < 5 * p["flux_err"]) & (p["mjd"] < F.col("candidate.mjd")))
    last = F.array_max(F.transform(limits, lambda p: p["mjd"]))
    rows = alerts.filter("classification IS NOT NULL")
    return rows.select("object_id", "candid", "candidate.ra", "candidate.dec", (F.col("candidate.mjd") + 2400000.5).alias("discovery_jd"), F.col("classification").alias("at_type"), last.alias("last_limit"))


def write_detections(detections: DataFrame, path: str) -> None:
    """Append detections to the store, partitioned by field."""
    detections.write.mode("append").partitionBy("field_id").parquet(path)


def store_counts(spark: SparkSession, path: str, schema) -> DataFrame:
    """Detections, objects and time range of every field in the store."""
    rows = spark.read.schema(schema).parquet(path)
    return rows.groupBy("field_id").agg(F.count("*").alias("n_detections"), F.countDistinct("object_truth").alias("n_objects"), F.min("mjd").alias("first_mjd"), F.max("mjd").alias("last_mjd"))


def series_frames(pixels: DataFrame) -> DataFrame:
    """Frames of a series in order of time (epoch, mjd, position, ny, nx, n, consistent): consistent where shape and count equal the first frame's."""
    from ..operators.match import number_rows

    frames = pixels.groupBy("epoch").agg(F.min("mjd").alias("mjd"), (F.max("y") + 1).alias("ny"), (F.max("x") + 1).alias("nx"), F.count("*").alias("n"))
    frames = number_rows(frames.withColumn("mjd", F.coalesce("mjd", F.col("epoch").cast("double"))), "mjd", "epoch").withColumnRenamed("number", "position")
    first = frames.filter("position = 1").select(F.struct("ny", "nx", "n").alias("first_"))
    return frames.join(F.broadcast(first)).withColumn("consistent", F.struct("ny", "nx", "n") == F.col("first_")).drop("first_")


def survey_planes(science: DataFrame, keys: list[str], mask: DataFrame | None = None, noise: DataFrame | None = None, kind: str = "error", bits: int | None = None, saturation: float | None = None) -> DataFrame:
    """Science pixels (keys, value) with ``bad`` and ``sigma`` from a mask plane (column bits) and a noise plane (column noise).

    Any mask bit is bad, or only the chosen ``bits``; a weight of zero or less, or none, is bad and has no sigma; so is a value at or above ``saturation`` bad.
    """
    if kind not in ("error", "variance", "weight"):
        raise ValueError(f"unknown noise plane {kind!r}")
    rows, bad = science, F.coalesce(F.col("value").isNull(), F.lit(True))
    if mask is not None:
        rows = rows.join(mask.select(*keys, F.col("bits").alias("bits_")), keys, "left")
        held = F.coalesce("bits_", F.lit(0))
        bad = bad | ((held if bits is None else held.bitwiseAND(bits)) != 0)
    sigma = F.lit(None).cast("double")
    if noise is not None:
        rows = rows.join(noise.select(*keys, F.col("noise").alias("noise_")), keys, "left")
        level = F.col("noise_")
        sigma = {"error": level, "variance": F.sqrt(F.greatest(level, F.lit(0.0))), "weight": F.when(level > 0, 1 / F.sqrt(level))}[kind]
        if kind == "weight":
            bad = bad | ~F.coalesce(level > 0, F.lit(False))
    if saturation is not None:
        bad = bad | F.coalesce(F.col("value") >= saturation, F.lit(False))
    return rows.withColumns({"bad": bad, "sigma": sigma}).drop("bits_", "noise_")
