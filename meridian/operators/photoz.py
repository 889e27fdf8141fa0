"""Photometric redshifts: colours against a library of template colours over redshift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fit(objects: DataFrame, library: DataFrame, key: str, colours: list[str], errors: list[str]) -> DataFrame:
    """Best and mean redshift, 16 and 84 % points and best template of each object.

    ``library`` (template, z, colours) is a fixed grid, broadcast; objects are exploded over it and reduced again in
    one aggregation per object and redshift, so the posterior is marginalised over templates by partial sums.
    """
    grid = library.select("template", "z", *[F.col(c).alias(f"t_{c}") for c in colours])
    chi2 = sum((((F.col(c) - F.col(f"t_{c}")) / F.col(e)) ** 2 for c, e in zip(colours, errors, strict=True)), F.lit(0.0))
    rows = objects.select(key, *colours, *errors).dropna().join(F.broadcast(grid)).withColumn("chi2", chi2)
    least = Window.partitionBy(key)
    rows = rows.withColumn("p", F.exp(-0.5 * (F.col("chi2") - F.min("chi2").over(least))))
    per_z = rows.groupBy(key, "z").agg(F.sum("p").alias("p"), F.min(F.struct(F.round("chi2", 9).alias("c"), "template", "chi2")).alias("b"))
    w = Window.partitionBy(key)
    per_z = per_z.withColumn("p", F.col("p") / F.sum("p").over(w)).withColumn("cum", F.sum("p").over(w.orderBy("z").rowsBetween(Window.unboundedPreceding, 0)))
    best = F.min(F.struct(F.col("b.c").alias("c"), "z", F.col("b.template").alias("template"), F.col("b.chi2").alias("chi2")))
    out = per_z.groupBy(key).agg(best.alias("best"), F.sum(F.col("p") * F.col("z")).alias("z_mean"), F.min(F.when(F.round("cum", 9) >= 0.16, F.col("z"))).alias("z_low"), F.min(F.when(F.round("cum", 9) >= 0.84, F.col("z"))).alias("z_high"))
    return out.select(key, F.col("best.z").alias("z_best"), F.col("best.template").alias("template"), F.col("best.chi2").alias("chi2"), "z_mean", "z_low", "z_high")


#: Centre and width of each filter in Angstrom.
FILTERS = {"u": (3550.0, 600.0), "g": (4770.0, 1400.0), "r": (6230.0, 1400.0), "i": (7620.0, 1500.0), "z": (9130.0, 1200.0), "y": (10200.0, 1100.0)}


def template_magnitudes(templates: DataFrame, redshifts: list[float], bands: list[str]) -> DataFrame:
    """(template, z, band, mag): -2.5 log of the mean flux through each filter, by trapezoids over (template, wavelength, flux).

    Neighbouring points are paired once; each pair is then worth a term at every redshift and filter, summed map-side.
    """
    o = Window.partitionBy("template").orderBy("wavelength")
    pairs = templates.select("template", F.col("wavelength").alias("w1"), F.col("flux").alias("f1"), F.lag("wavelength").over(o).alias("w0"), F.lag("flux").over(o).alias("f0")).filter("w0 IS NOT NULL")
    shape = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.lit(FILTERS[b][0]).alias("centre"), F.lit(FILTERS[b][1]).alias("width")) for b in bands])).alias("s")
    rows = pairs.withColumn("z", F.explode(F.array(*[F.lit(float(z)) for z in redshifts]))).select("*", shape).select("*", "s.*")

    def through(w):
        edge = 0.06 * F.col("width")
        left = 0.5 * (1 + F.tanh((w - (F.col("centre") - 0.5 * F.col("width"))) / edge))
        return left * 0.5 * (1 - F.tanh((w - (F.col("centre") + 0.5 * F.col("width"))) / edge)) / w

    a, b = F.col("w0") * (1 + F.col("z")), F.col("w1") * (1 + F.col("z"))
    rows = rows.select("template", "z", "band", F.col("f0"), F.col("f1"), through(a).alias("t0"), through(b).alias("t1"), ((b - a) / 2).alias("half"))
    top, bottom = F.sum(F.col("half") * (F.col("f0") * F.col("t0") + F.col("f1") * F.col("t1"))), F.sum(F.col("half") * (F.col("t0") + F.col("t1")))
    sums = rows.groupBy("template", "z", "band").agg(top.alias("top"), bottom.alias("bottom"))
    return sums.select("template", "z", "band", F.when((F.col("bottom") > 0) & (F.col("top") > 0), -2.5 * F.log10(F.col("top") / F.col("bottom"))).alias("mag"))


def colour_grid(templates: DataFrame, redshifts: list[float], bands: list[str]) -> DataFrame:
    """(template, z, first_second, ...): differences of neighbouring bands at every redshift, as ``fit`` takes them."""
    wide = template_magnitudes(templates, redshifts, bands).groupBy("template", "z").agg(*[F.max(F.when(F.col("band") == b, F.col("mag"))).alias(f"m_{b}") for b in bands])
    return wide.select("template", "z", *[(F.col(f"m_{a}") - F.col(f"m_{b}")).alias(f"{a}_{b}") for a, b in zip(bands, bands[1:], strict=False)])
