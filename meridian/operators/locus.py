"""The stellar locus of a field: a clipped curve through the colours of compact sources, and how far from it the kinds scatter.

Rows are (id, x, y, stellarity, snr): two colours, the stellarity of the shape and the signal to noise.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import horner
from .fit import solve
from .population import auc
from .quantiles import group_quantiles, median_and_mad, quantiles

#: Stellarity of a star and of a galaxy; share and width of outliers; largest confidence; least AUC of use and the span to full weight.
STAR, GALAXY, OUTLIERS, BROAD, MOST_SURE, FLOOR, SPAN = 0.6, 0.3, 0.05, 4.0, 0.92, 0.58, 0.30
#: Samples of the curve, their reach beyond the stars, ratio of widths that informs, slack in log10 S/N below the faintest bin, trimmed share.
SAMPLES, BEYOND, WIDER, SLACK, TRIM = 128, 0.15, 1.15, 0.25, 0.9


@dataclass
class Locus:
    """Coefficients (highest power first) and what has been measured about them; of a size that does not depend on the rows."""

    coefficients: list[float]
    low: float
    high: float
    n_stars: int = 0
    scatter: float = 0.0
    centres: list[float] = field(default_factory=list)
    star_width: list[float] = field(default_factory=list)
    galaxy_width: list[float] = field(default_factory=list)
    n_galaxies: int = 0
    separation: float = 0.5

    @property
    def informative(self) -> bool:
        return any(g > WIDER * s for s, g in zip(self.star_width, self.galaxy_width, strict=True))

    @property
    def weight(self) -> float:
        """Trust in the colours, from 0 at an AUC of the floor to 1."""
        return min(1.0, max(0.0, (self.separation - FLOOR) / SPAN)) if self.informative else 0.0

    def distance(self, x: Column, y: Column) -> Column:
        """Smallest distance to the sampled curve."""
        span = self.high - self.low
        grid = np.linspace(self.low - BEYOND * span, self.high + BEYOND * span, SAMPLES)
        curve = np.polyval(self.coefficients, grid)
        points = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in zip(grid, curve, strict=True)])
        away = F.array_min(F.transform(points, lambda p: (p["a"] - x) * (p["a"] - x) + (p["b"] - y) * (p["b"] - y)))
        return F.when(x.isNotNull() & y.isNotNull(), F.sqrt(away))

    def _width(self, key: Column, widths: list[float]) -> Column:
        """Linear interpolation over the bins, flat beyond the last; null fainter than the first less the slack."""
        out = F.lit(widths[-1])
        for i in range(len(widths) - 1, 0, -1):
            c0, c1, w0, w1 = self.centres[i - 1], self.centres[i], widths[i - 1], widths[i]
            out = F.when(key <= c1, F.lit(w0) + (key - c0) / (c1 - c0) * (w1 - w0)).otherwise(out)
        out = F.when(key <= self.centres[0], F.lit(widths[0])).otherwise(out)
        return F.when(key >= self.centres[0] - SLACK, out)

    def stellarity(self, x: Column, y: Column, snr: Column) -> Column:
        """Probability of a star from the distance alone: Rayleigh densities of both widths, each with a broad outlier term."""
        if not self.informative:
            return F.lit(0.5)
        key = F.log10(F.when(snr > 0, snr))
        star = self._width(key, self.star_width)
        galaxy = F.greatest(self._width(key, self.galaxy_width), star)
        d = self.distance(x, y)

        def rayleigh(scale: Column) -> Column:
            return d / (scale * scale) * F.exp(-0.5 * (d / scale) * (d / scale))

        outlier = OUTLIERS * rayleigh(BROAD * galaxy)
        a, b = ((1 - OUTLIERS) * rayleigh(s) + outlier for s in (star, galaxy))
        value = F.when(galaxy <= star * 1.001, 0.5).when(a + b <= 0, 0.5).otherwise(a / (a + b))
        return F.when(star.isNotNull() & d.isNotNull() & (star > 0), F.least(F.greatest(value, F.lit(1 - MOST_SURE)), F.lit(MOST_SURE)))


def fit_locus(rows: DataFrame, degree: int = 3, least: int = 12, clip: float = 2.5, rounds: int = 4) -> Locus | None:
    """The curve of y over x through compact rows (all, if no row has a stellarity), clipped by scaled MADs; None with too few."""
    rows = rows.filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    seeded = rows.filter("stellarity IS NOT NULL").limit(1).count() > 0
    points = rows.filter((F.col("stellarity") >= STAR) | F.col("stellarity").isNull()) if seeded else rows
    n = points.count()
    if n < least:
        return None
    order = min(degree, max(1, n // 6))
    powers = [F.pow("x", F.lit(float(order - i))) for i in range(order + 1)]
    c = [float(v) for v in solve(points, powers, F.col("y"))]
    kept, before = points, n
    for _ in range(rounds):
        residual = F.col("y") - horner(F.col("x"), c)
        spread = median_and_mad(kept.select(residual.alias("r")), "r")[1]
        if not spread > 0:
            break
        updated = points.filter(F.abs(residual) <= clip * spread)
        # the same rows: equal in number, and none of them outside
        n_new, n_both = updated.agg(F.count("*")).first()[0], kept.filter(F.abs(residual) <= clip * spread).count()
        if n_new < least:
            break
        same, kept, before = n_new == n_both == before, updated, n_new
        if same:
            break
        c = [float(v) for v in solve(kept, powers, F.col("y"))]
    low, high = kept.agg(F.min("x"), F.max("x")).first()
    locus = Locus(c, float(low), float(high), before)
    locus.scatter = math.sqrt(kept.agg(F.avg(locus.distance(F.col("x"), F.col("y")) ** 2)).first()[0] or 0.0)
    return locus


def rayleigh_widths(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., width, n) of distances d: root of half the mean square, of groups of five or more without the farthest tenth."""
    limit = group_quantiles(rows, by, "d", [TRIM]).select(*by, F.col("value").alias("limit_"), F.col("n").alias("n_"))
    kept = rows.join(limit, by).filter((F.col("n_") < 5) | (F.col("d") <= F.col("limit_")))
    return kept.groupBy(*by).agg(F.sqrt(F.avg(F.col("d") * F.col("d")) / 2).alias("width"), F.max("n_").alias("n"))


def calibrate(rows: DataFrame, locus: Locus, bins: int = 3, least: int = 6) -> Locus:
    """Adds the widths of stars and galaxies in bins of the stars' log10 S/N, and the AUC with which colours tell them apart.

    A bin with too few stars is left out; one with too few galaxies takes the width of all of them.
    """
    kind = F.when(F.col("stellarity") >= STAR, 1).when(F.col("stellarity") <= GALAXY, 0)
    told = rows.select(locus.distance(F.col("x"), F.col("y")).alias("d"), F.log10(F.when(F.col("snr") > 0, F.col("snr"))).alias("key"), kind.alias("star"), "x", "y", "snr").filter("d IS NOT NULL AND star IS NOT NULL")
    placed = told.filter("key IS NOT NULL")
    sizes = {r.star: r["count"] for r in placed.groupBy("star").count().collect()}
    locus.n_galaxies = sizes.get(0, 0)
    if min(sizes.get(0, 0), sizes.get(1, 0)) >= least:
        edges = quantiles(placed.filter("star = 1"), "key", [i / bins for i in range(bins + 1)])
        edges[0] -= 1e-6
        bin_of = F.lit(None).cast("int")
        for i in range(bins):
            bin_of = F.when((F.col("key") > edges[i]) & (F.col("key") <= edges[i + 1]), i).otherwise(bin_of)
        widths = {(r.star, r.bin): r for r in rayleigh_widths(placed.withColumn("bin", bin_of).filter("bin IS NOT NULL"), ["star", "bin"]).collect()}
        every = {r.star: r.width for r in rayleigh_widths(placed.filter("star = 0"), ["star"]).collect()}
        for i in range(bins):
            star, galaxy = widths.get((1, i)), widths.get((0, i))
            if star and star.n >= least:
                locus.centres.append(0.5 * (edges[i] + edges[i + 1]))
                locus.star_width.append(star.width)
                locus.galaxy_width.append(max(galaxy.width if galaxy and galaxy.n >= least else every[0], star.width))
    scored = told.select(locus.stellarity(F.col("x"), F.col("y"), F.col("snr")).alias("score"), "star").filter("score IS NOT NULL")
    counts = {r.star: r["count"] for r in scored.groupBy("star").count().collect()}
    if min(counts.get(0, 0), counts.get(1, 0)) >= 5:
        locus.separation = float(auc(scored, "score", "star").first().auc)
    return locus
