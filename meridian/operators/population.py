"""Population summaries of catalogs: counts, slopes, completeness, luminosity functions, digests, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cosmology import Cosmology
from .catalog import by_redshift
from .match import number_rows
from .rounds import cut


def number_counts(rows: DataFrame, mag: Column, width: float = 0.5) -> DataFrame:
    """bin, n, log_n over floor(m / w) w bins; empty bins between the ends are kept with n = 0."""
    counts = rows.select(F.floor(mag / width).alias("k")).filter("k IS NOT NULL").groupBy("k").count()
    ends = counts.agg(F.min("k").alias("lo"), F.max("k").alias("hi")).filter("lo IS NOT NULL")
    bins = ends.select(F.explode(F.sequence("lo", "hi")).alias("k")).join(counts, "k", "left")
    n = F.coalesce("count", F.lit(0))
    return bins.select((F.col("k") * width).cast("double").alias("bin"), n.cast("long").alias("n"), F.when(n > 0, F.log10(n)).alias("log_n"))


def counts_slope(counts: DataFrame) -> DataFrame:
    """Least-squares slope of log N on magnitude, from three bins on."""
    return counts.agg(F.when(F.count("log_n") >= 3, F.regr_slope("log_n", "bin")).alias("slope"))


def completeness(counts: DataFrame) -> DataFrame:
    """First bin with the most counts, from four bins on."""
    return counts.agg(F.when(F.count("*") >= 4, F.max(F.struct("n", (-F.col("bin")).alias("m")))["m"] * -1).alias("limit_mag"))


def feature_report(rows: DataFrame, names: list[str]) -> DataFrame:
    """Finite share, median and population deviation of each column, in one pass over the stacked columns."""
    stack = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])).alias("s")
    return rows.select(stack).select("s.*").groupBy("feature").agg(F.avg(F.col("value").isNotNull().cast("double")).alias("finite"), F.median("value").alias("median"), F.stddev_pop("value").alias("std"))


def digest(rows: DataFrame, columns: list[str], precision: int = 6) -> DataFrame:
    """Order-insensitive digest: count and the sum and xor of the rows' hashes, partial in every task."""
    h = F.xxhash64(*[F.round(c, precision) for c in columns])
    return rows.select(h.alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("xor"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("total"))


def field_reference(rows: DataFrame) -> DataFrame:
    """Medians of the resolved sources that other classes are judged against."""
    return rows.filter("area_pixels > 20").agg(F.median("area_pixels").alias("area"), F.median("r50").alias("r50"), F.count("*").alias("n_resolved"))


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Uniform-bin reliability curve of (score, y)."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("y").cast("double")).alias("observed"))


def calibration_errors(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error, worst bin, Brier score and whether the error is at most 0.15."""
    curve = reliability(rows, bins).withColumn("gap", F.abs(F.col("mean_score") - F.col("observed")))
    out = curve.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("worst"))
    brier = rows.agg(F.avg(F.pow(F.col("score") - F.col("y"), F.lit(2.0))).alias("brier"))
    return out.join(brier).withColumn("usable", F.col("ece") <= 0.15)


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Mann-Whitney area from counts per distinct score; ties count half."""
    from pyspark.sql import Window

    per = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("q"))
    # scores are dealt into ranges; only one row per range meets in the running sum of negatives
    per = per.withColumn("cell", F.floor(F.col("s") * 1000))
    cells = per.groupBy("cell").agg(F.sum("q").alias("cq")).withColumn("below_cell", F.coalesce(F.sum("cq").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.coalesce(F.sum("q").over(Window.partitionBy("cell").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("inner", inner).join(cells.select("cell", "below_cell"), "cell")
    won = F.sum(F.col("p") * (F.col("below_cell") + F.col("inner") + 0.5 * F.col("q")))
    return per.agg((won / (F.sum("p") * F.sum("q"))).alias("auc"))


def luminosity_function(rows: DataFrame, mag: Column, z: float, square_degrees: float, cosmology: Cosmology, width: float = 0.5) -> DataFrame:
    """bin, n and phi (per Mpc3 and magnitude) of absolute magnitudes at one redshift; empty below three magnitudes."""
    one = rows.sparkSession.range(1).select(cosmology.modulus(F.lit(z)).alias("mu"), cosmology.volume(F.lit(z), square_degrees).alias("v")).first()
    counts = number_counts(rows, mag - one["mu"], width)
    enough = counts.agg(F.sum("n").alias("all")).filter("all >= 3")
    return counts.join(F.broadcast(enough)).select("bin", "n", (F.col("n") / max(one["v"] * width, 1e-9)).alias("phi"))


def annotate(rows: DataFrame, cosmology: Cosmology, scale: float, extended: Column, magnitude: Column, field_z: float | None = None, nominal_z: float | None = None) -> DataFrame:
    """Redshift, where it comes from, and the lengths and luminosities that follow from it.

    ``photoz`` with ``reliable`` comes first, then the field's redshift, then a nominal one for extended sources; without
    any, only the angular size is given.
    """
    own = F.col("photoz")
    z = F.coalesce(own, F.lit(field_z).cast("double"), F.when(extended, F.lit(nominal_z).cast("double")))
    source = F.when(own.isNotNull() & F.col("reliable"), "photometric").when(own.isNotNull(), "photometric_unreliable")
    source = source.when(F.lit(field_z is not None), "assumed_field").when(extended & F.lit(nominal_z is not None), "assumed_nominal")
    angular = 2 * F.col("semi_major") * scale
    rows = rows.withColumns({"z": z, "redshift_source": source, "angular_arcsec": angular, "mag_": magnitude})
    rows = by_redshift(rows, lambda c: {"modulus_": cosmology.modulus(c), "kpc_": cosmology.kpc_per_arcsec(c), "lookback_": cosmology.lookback(c)}, "z")
    known = F.col("z") > 0
    return rows.withColumns({
        "size_kpc": F.when(known & (angular > 0), angular * F.col("kpc_")), "absolute_mag": F.when(known, F.col("mag_") - F.col("modulus_")), "lookback_gyr": F.when(known, F.col("lookback_")),
    }).drop("mag_", "modulus_", "kpc_", "lookback_")


def average_precision(predicted: DataFrame, matched: DataFrame, truths: int, block: int = 100_000) -> DataFrame:
    """Area under the precision envelope over recall.

    ``predicted`` (id, score) are all predictions and ``matched`` (id) those that found a truth. Precision peaks only at a
    match, so after ranking all predictions only matches are kept; the running maximum from the end goes block by block.
    """
    ranks = number_rows(predicted.select("id", (-F.col("score")).alias("down")), "down", "id").select("id", F.col("number").alias("rank"))
    hits = cut(number_rows(ranks.join(matched.select("id"), "id", "left_semi"), "rank"))
    hits = hits.select(F.floor(F.col("number") / block).alias("block"), "number", (F.col("number") / F.col("rank")).alias("precision"))
    tops = hits.groupBy("block").agg(F.max("precision").alias("top"))
    later = tops.withColumn("later", F.max("top").over(Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1))).drop("top")
    within = F.max("precision").over(Window.partitionBy("block").orderBy(F.desc("number")))
    envelope = hits.withColumn("within", within).join(F.broadcast(later), "block").select(F.greatest("within", F.coalesce("later", F.lit(0.0))).alias("p"))
    return envelope.agg((F.coalesce(F.sum("p"), F.lit(0.0)) / max(truths, 1)).alias("average_precision"))
