"""Growth curves, adaptive apertures, Sersic profile scans and tiled stages over pixel frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import sersic_b
from .frames import by_cells, petrosian_radius, ring_sky
from .pixels import covered


def growth_curve(pixels: DataFrame, frame: str, cx: float, cy: float, most: float, steps: int = 30, parts: int = 4) -> DataFrame:
    """(frame, k, radius, enclosed) at ``steps`` radii from 0.75; every pixel is split into parts x parts points, each counted once at its first radius."""
    step = (most - 0.75) / (steps - 1)
    offsets = [(i + 0.5) / parts - 0.5 for i in range(parts)]
    points = F.array(*[F.hypot(F.col("x") + (a - cx), F.col("y") + (b - cy)) for a in offsets for b in offsets])
    rows = pixels.select(frame, (F.col("value") / parts**2).alias("part"), F.explode(points).alias("r")).filter(F.col("r") <= most)
    k = F.greatest(F.ceil((F.col("r") - 0.75) / step), F.lit(0)).cast("int").alias("k")
    found = rows.groupBy(frame, k).agg(F.sum("part").alias("part"))
    every = pixels.select(frame).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    inside = F.sum(F.coalesce("part", F.lit(0.0))).over(Window.partitionBy(frame).orderBy("k"))
    return every.join(found, [frame, "k"], "left").select(frame, "k", (0.75 + F.col("k") * step).alias("radius"), inside.alias("enclosed"))


def flux_radii(growth: DataFrame, frame: str, shares: dict[str, float]) -> DataFrame:
    """One column per share: the radius that encloses it, linear between steps; null where the total is not positive."""
    o = Window.partitionBy(frame).orderBy("k")
    rows = growth.withColumns({"total": F.last("enclosed").over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "e0": F.lag("enclosed").over(o), "r0": F.lag("radius").over(o)})
    columns = []
    for name, share in shares.items():
        target = share * F.col("total")
        rise = F.col("enclosed") - F.col("e0")
        at = F.when(F.col("e0").isNull() | (F.abs(rise) < 1e-12), F.col("radius")).otherwise(F.col("r0") + (target - F.col("e0")) / rise * (F.col("radius") - F.col("r0")))
        reached = F.when((F.col("total") > 0) & (F.col("enclosed") >= target), F.struct("k", at.alias("at")))
        columns.append(F.min(reached)["at"].alias(name))
    return rows.groupBy(frame).agg(*columns)


def concentration(pixels: DataFrame, frame: str, cx: float, cy: float, most: float) -> DataFrame:
    """Radii of 20, 50 and 80 % of the light and 5 log10(r80 / r20)."""
    radii = flux_radii(growth_curve(pixels, frame, cx, cy, most), frame, {"r20": 0.2, "r50": 0.5, "r80": 0.8})
    return radii.withColumn("concentration", F.when(F.col("r20") > 0, 5 * F.log10(F.col("r80") / F.col("r20"))))


def adaptive_aperture(pixels: DataFrame, frame: str, cx: float, cy: float, least: float = 2.0, most: float = 40.0, factor: float = 2.5) -> DataFrame:
    """Aperture radius from the first moment of the light, else twice the Petrosian radius, else ``least``."""
    r, light = F.hypot(F.col("x") - cx, F.col("y") - cy), F.greatest("value", F.lit(0.0))
    near = pixels.withColumns({"r": r, "light": F.when(r <= most, light).otherwise(0.0)})
    kron = near.groupBy(frame).agg(F.when(F.sum("light") > 0, F.sum(F.col("light") * F.col("r")) / F.sum("light")).alias("kron"))
    petro = petrosian_radius(pixels, frame, cx, cy, 0.2, most).withColumnRenamed("radius", "petrosian")
    bounded = lambda c: F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(least)), F.lit(most)))
    radius = F.coalesce(bounded(factor * F.col("kron")), bounded(2 * F.col("petrosian")), F.lit(least))
    return kron.join(petro, frame, "left").select(frame, radius.alias("radius"), "kron", "petrosian")


def sersic_scan(profile: DataFrame, frame: str, trials: list[float] | None = None) -> DataFrame:
    """Best Sersic index, effective radius, amplitude and chi2 of each profile (frame, r, value).

    For a fixed index the log of the intensity is linear in r^(1/n), so a trial is one regression; profiles of fewer than
    four positive points, or that do not decline, give nulls. All trials of a profile are one aggregation.
    """
    if trials is None:
        trials = [0.3 + 1.7 * i / 34 for i in range(35)] + [2.1 + 5.9 * i / 39 for i in range(40)]
    n = F.explode(F.array(*[F.lit(t) for t in trials])).alias("n")
    rows = profile.filter("value > 0 AND r > 0").select(frame, "r", "value", n)
    u, target = F.pow("r", 1 / F.col("n")), F.log("value")
    points = F.collect_list(F.struct("r", "value"))
    fits = rows.groupBy(frame, "n").agg(F.regr_slope(target, u).alias("slope"), F.regr_intercept(target, u).alias("start"), F.max("r").alias("far"), points.alias("points"))
    b = sersic_b(F.col("n")) + 131 / (1148175 * F.pow("n", F.lit(3.0)))
    fits = fits.filter((F.size("points") >= 4) & (F.col("slope") < 0)).withColumns({"r_eff": F.pow(-b / F.col("slope"), F.col("n")), "amplitude": F.exp(F.col("start") - b), "b": b})
    off = F.aggregate("points", F.lit(0.0), lambda s, p: s + F.pow(p["value"] - F.col("amplitude") * F.exp(-F.col("b") * (F.pow(p["r"] / F.col("r_eff"), 1 / F.col("n")) - 1)), F.lit(2.0)))
    fits = fits.filter("r_eff > 0 AND r_eff <= 10 * far").withColumn("chi2", off)
    best = fits.groupBy(frame).agg(F.min(F.struct(F.round("chi2", 9).alias("c"), "n", "r_eff", "amplitude", "chi2")).alias("b"))
    return profile.select(frame).distinct().join(best, frame, "left").select(frame, "b.n", "b.r_eff", "b.amplitude", "b.chi2")


def aperture_fluxes(sources: DataFrame, pixels: DataFrame, frame: str, radius: float, inner: float, outer: float) -> DataFrame:
    """Sky-subtracted flux, error and area of each source (source_id, frame, sx, sy) in its own frame; the sky is the clipped median of a ring."""

    def stage(sx, sy, x, y, value, rms):
        w = covered(x, y, sx, sy, radius)
        return w @ value, w @ np.nan_to_num(rms * rms), w.sum(axis=1), *ring_sky(sx, sy, x, y, value, inner, outer)

    sums = by_cells(sources, pixels, frame, max(radius + 1, outer), stage, "flux double, var double, area double, level double, level_rms double, n long").filter("area > 0")
    spread = F.when(F.col("n") > 0, F.col("area") ** 2 * F.col("level_rms") ** 2 / F.col("n")).otherwise(0.0)
    return sums.select("source_id", frame, (F.col("flux") - F.col("area") * F.col("level")).alias("flux"), F.sqrt(F.col("var") + spread).alias("flux_err"), "area")


def per_tile(pixels: DataFrame, frame: str, tile: int, overlap: int, stage, schema: str) -> DataFrame:
    """Run ``stage`` (pandas to pandas, with y and x in its result) on every tile with its overlap; a result stays only where its position lies in the tile's own part."""

    def tiles(c: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - overlap) / tile), F.floor((F.col(c) + overlap) / tile)))

    cut = pixels.withColumn("ty_", tiles("y")).withColumn("tx_", tiles("x"))

    def run(key, part):
        return stage(part.drop(columns=["ty_", "tx_"])).assign(ty_=key[1], tx_=key[2])

    done = cut.groupBy(frame, "ty_", "tx_").applyInPandas(run, f"{schema}, ty_ long, tx_ long")
    return done.filter((F.floor(F.col("y") / tile) == F.col("ty_")) & (F.floor(F.col("x") / tile) == F.col("tx_"))).drop("ty_", "tx_")
