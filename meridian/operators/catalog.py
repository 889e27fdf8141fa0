"""Operations on flat source catalogs: flags, colours, rules, sky cover, tiles and redshift columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import POGSON, finite, lit_map, magnitude
from ..functions.sky import separation, with_healpix_centre
from .rounds import cut

#: Classes of resolved sources, and descriptions of object-type codes.
EXTENDED = ["galaxy", "nebula", "star_cluster"]
OBJECT_TYPES = {"*": "star", "V*": "variable star", "G": "galaxy", "QSO": "quasar"}


def is_extended(kind: Column) -> Column:
    return kind.isin(EXTENDED)


def described_type(code: Column) -> Column:
    return F.coalesce(lit_map(OBJECT_TYPES)[code], code)


def add_flag(flags: Column, name: str, test: Column | None = None) -> Column:
    added = F.array_union(flags, F.array(F.lit(name)))
    return added if test is None else F.when(test, added).otherwise(flags)


def is_detection(mag: Column, flux: Column, flux_err: Column, least: float = 5.0) -> Column:
    return F.coalesce(mag.isNotNull() | (flux / flux_err >= least), F.lit(False))


def band_magnitudes(detections: DataFrame, key: str, zero_point: float = 25.0) -> DataFrame:
    """One row per object and band: magnitude of the mean flux and its error."""
    flux, err = F.avg("flux"), F.avg("flux_err") / F.sqrt(F.count("*"))
    return detections.groupBy(key, "band").agg(F.when(flux > 0, zero_point - 2.5 * F.log10(flux)).alias("mag"), F.when(flux > 0, POGSON * err / flux).alias("err"))


def colour(bands: DataFrame, key: str, blue: str, red: str) -> DataFrame:
    """Colour and its error from one aggregation over the bands, no self-join."""
    def of(column: str, band: str) -> Column:
        return F.max(F.when(F.col("band") == band, F.col(column)))

    return bands.filter(F.col("band").isin(blue, red)).groupBy(key).agg((of("mag", blue) - of("mag", red)).alias("colour"), F.sqrt(of("err", blue) ** 2 + of("err", red) ** 2).alias("colour_err"))


def gated_colour(detections: DataFrame, key: str, blue: str, red: str, least: float) -> DataFrame:
    """Colour where both bands reach the signal to noise; a one-sided limit where exactly one does."""
    def of(band: str, column: str) -> Column:
        return F.avg(F.when(F.col("band") == band, F.col(column)))

    def n(band: str) -> Column:
        return F.sqrt(F.count(F.when(F.col("band") == band, 1)))

    rows = detections.groupBy(key).agg(of(blue, "flux").alias("fa"), (of(blue, "flux_err") / n(blue)).alias("ea"), of(red, "flux").alias("fb"), (of(red, "flux_err") / n(red)).alias("eb"))
    a, b = F.coalesce(F.col("fa") / F.col("ea") >= least, F.lit(False)), F.coalesce(F.col("fb") / F.col("eb") >= least, F.lit(False))
    kind = F.when(a & b, "measured").when(b, "lower").when(a, "upper").otherwise("none")
    value = F.when(a & b, -2.5 * F.log10(F.col("fa") / F.col("fb"))).when(b, -2.5 * F.log10(least * F.col("ea") / F.col("fb"))).when(a, -2.5 * F.log10(F.col("fa") / (least * F.col("eb"))))
    return rows.select(key, kind.alias("kind"), value.alias("colour"))


def by_redshift(rows: DataFrame, columns, z: str = "redshift") -> DataFrame:
    """Adds costly columns of a redshift, computed once per distinct value and joined back; a table of distinct redshifts
    is broadcast by the optimizer only when it is small."""
    grid = rows.select(z).distinct()
    return rows.join(grid.withColumns(columns(F.col(z))), z, "left")


def merger_statistic() -> Column:
    return F.col("gini") - (-0.14 * F.col("m20") + 0.33)


def bulge_statistic() -> Column:
    return F.col("gini") - (0.14 * F.col("m20") + 0.80)


def sersic_b(n: Column) -> Column:
    """Series of Ciotti and Bertin (1999) for the profile constant."""
    return 2 * n - 1 / 3 + 4 / (405 * n) + 46 / (25515 * n * n)


def sersic(r: Column, r_e: Column, n: Column) -> Column:
    """Intensity at r over that at the effective radius."""
    return F.exp(-sersic_b(n) * (F.pow(r / r_e, 1 / n) - 1))


def uncertainty(p: Column, method: str) -> Column:
    ranked = F.sort_array(p, asc=False)
    if method == "margin":
        return 1 - (ranked[0] - ranked[1])
    if method == "least_confident":
        return 1 - ranked[0]
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + F.when(x > 0, x * F.log(x)).otherwise(0.0))
    return -total / F.log(F.size(p).cast("double"))


def cone_cover(spark: SparkSession, ra: float, dec: float, radius_deg: float, nside: int, start: int = 16) -> DataFrame:
    """Nested pixels that may touch a cone: coarse pixels are kept by distance and split in four, level by level."""
    level, n = spark.range(12 * start * start).withColumnRenamed("id", "pixel"), start
    while True:
        reach = radius_deg + 1.5 * 58.6 / n  # a pixel lies within this of its centre
        level = cut(with_healpix_centre(level, n, "pixel")).filter(separation(F.col("ra"), F.col("dec"), F.lit(float(ra)), F.lit(float(dec))) <= reach).select("pixel")
        if n == nside:
            return level
        level = level.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).select((4 * F.col("pixel") + F.col("k")).alias("pixel"))
        n *= 2


def in_tiles(rows: DataFrame, axis: str, size: int, tile: int, overlap: int) -> DataFrame:
    """Each row once per tile that holds it along an axis; tiles advance by tile - overlap."""
    step = tile - overlap
    last = max(0, -(-(size - tile) // step))
    low = F.greatest(F.floor((F.col(axis) - tile) / step) + 1, F.lit(0))
    return rows.withColumn("tile", F.explode(F.sequence(low.cast("int"), F.least(F.floor(F.col(axis) / step), F.lit(last)).cast("int"))))


def map_items(rows: DataFrame, function, schema: str) -> DataFrame:
    """A user's function of a pandas frame over every Arrow batch."""
    def run(parts):
        for part in parts:
            yield function(part)

    return rows.mapInPandas(run, schema)


def nest_sources(rows: DataFrame) -> DataFrame:
    """Flat source rows as nested records: photometry and morphology structs and an array of flags."""
    photometry = F.struct("flux", "flux_err", "fwhm")
    morphology = F.struct("concentration", "asymmetry", "gini", "m20")
    flags = F.filter(F.split(F.coalesce("flags", F.lit("")), r"\|"), lambda x: x != "")
    return rows.select("source_id", "x", "y", "class", "semi_major", "area_pixels", photometry.alias("photometry"), morphology.alias("morphology"), flags.alias("flags"))


def flatten_sources(rows: DataFrame) -> DataFrame:
    """The flat row of a nested source: flags joined by a bar, a missing half axis from the area, 1 at least."""
    half = F.coalesce("semi_major", F.greatest(F.sqrt(F.col("area_pixels").cast("double")) / 2, F.lit(1.0)))
    return rows.select("source_id", "x", "y", "class", half.alias("semi_major"), "photometry.*", "morphology.*", F.concat_ws("|", "flags").alias("flags"))


def compare_metrics(ours: DataFrame, theirs: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Per metric of two catalogs: rows in both, median difference, its robust scatter and Spearman's rank correlation."""
    long = [side.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("p")).select(key, "p.metric", F.col("p.v").alias(n)) for side, n in ((ours, "a"), (theirs, "b"))]
    both = long[0].join(long[1], [key, "metric"]).filter("a IS NOT NULL AND b IS NOT NULL").withColumn("d", F.col("a") - F.col("b"))
    for side in ("a", "b"):  # average rank of ties, from counts of the values
        values = both.groupBy("metric", side).agg(F.count("*").alias("times"))
        below = F.sum("times").over(Window.partitionBy("metric").orderBy(side))
        ranks = values.select("metric", side, (below - (F.col("times") - 1) / 2).alias(f"rank_{side}"))
        both = both.join(ranks, ["metric", side])
    middle = both.groupBy("metric").agg(F.count("*").alias("n"), F.median("d").alias("median_difference"), F.corr("rank_a", "rank_b").alias("spearman"))
    scatter = both.join(middle.select("metric", "median_difference"), "metric").groupBy("metric").agg((1.4826 * F.median(F.abs(F.col("d") - F.col("median_difference")))).alias("scatter"))
    return middle.join(scatter, "metric")


def tabular_features(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Feature array of each row; what is missing or not finite takes the median of its column."""
    clean = rows.select(key, *[finite(F.col(n).cast("double")).alias(n) for n in names])
    middle = clean.agg(*[F.median(n).alias(f"_{n}") for n in names])
    return clean.crossJoin(F.broadcast(middle)).select(key, F.array(*[F.coalesce(n, f"_{n}") for n in names]).alias("features"))


def narrative(rows: DataFrame) -> DataFrame:
    """One sentence on each source."""
    shape = F.when(F.col("ellipticity") > 0.5, "elongated").when(F.col("ellipticity") > 0.2, "oval").otherwise("round")
    snr = F.format_string("%.1f", F.col("flux") / F.col("flux_err"))
    return rows.select("source_id", F.concat(F.lit("Source "), F.col("source_id").cast("string"), F.lit(" is a "), shape, F.lit(" "), F.col("class"), F.lit(" with signal to noise "), snr).alias("text"))


def standards(catalog: DataFrame, pairs: DataFrame, reference: DataFrame, least_snr: float = 20.0) -> DataFrame:
    """Catalog rows (id, flux, flux_err) with the magnitude of their nearest reference: bright enough and with a finite one. ``pairs``: a_id, b_id, nearest only."""
    good = catalog.filter(F.col("flux") >= least_snr * F.col("flux_err"))
    known = reference.filter(finite(F.col("mag_r")).isNotNull()).select(F.col("ref_id").alias("b_id"), "mag_r")
    return good.join(pairs, good["id"] == pairs["a_id"]).join(known, "b_id").select("id", "b_id", magnitude(F.col("flux")).alias("instrumental"), "mag_r")


def ranked(rows: DataFrame, group: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each group with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= most)
