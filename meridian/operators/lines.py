"""Spectral lines: fluxes of blended groups at a known redshift, and wavelength solutions by voting.

Spectra are rows (spec_id, pix, wavelength, flux, error). Fits are sums over pixels by Spark; only the small Gram matrices,
one for each spectrum, group and width, are solved in batches of rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import cut

#: Rest wavelengths in Angstrom, by name, and the Balmer lines among them.
LINES = {
    "[O II]": 3727.4, "Ca K": 3933.7, "Ca H": 3968.5, "H delta": 4101.7, "G band": 4304.4, "H gamma": 4340.5, "H beta": 4861.3, "[O III] 4959": 4958.9, "[O III] 5007": 5006.8,
    "Mg b": 5175.0, "Na D": 5892.5, "[O I] 6300": 6300.3, "H alpha": 6562.8, "[N II] 6548": 6548.0, "[N II] 6584": 6583.5, "[S II] 6716": 6716.4, "[S II] 6731": 6730.8,
}
BALMER = ("H alpha", "H beta", "H gamma", "H delta")
#: Separation of a blend in widths, sigmas of a detection, width in km/s of stellar absorption, trial widths.
BLEND, DETECTED, STELLAR, WIDTHS = 4.0, 3.0, 350.0, 28
LIGHT = 299792.458
FWHM = 2.3548
#: Width in Angstrom of the cells in which pixels and groups meet.
CELL = 128.0
#: Places of peaks that a vote holds at a time.
MOST_VOTES = 1 << 20


def line_groups(redshifts: DataFrame, names: list[str], resolution: float, top: float) -> DataFrame:
    """(spec_id, grp, centres, names): lines of each spectrum whose widest profiles overlap, as one group. ``redshifts``: (spec_id, z)."""
    chosen = sorted((n for n in names if n in LINES), key=LINES.get)
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(LINES[n]).alias("rest")) for n in chosen])
    rows = redshifts.select("spec_id", "z", F.explode(table).alias("line")).select("spec_id", "line.name", (F.col("line.rest") * (1 + F.col("z"))).alias("centre"))
    order = Window.partitionBy("spec_id").orderBy("centre")
    widest = F.sqrt(F.lit((resolution / FWHM) ** 2) + (F.col("centre") * top / LIGHT) ** 2)
    apart = F.coalesce((F.col("centre") - F.lag("centre").over(order) >= BLEND * widest).cast("int"), F.lit(1))
    rows = rows.withColumn("apart", apart).withColumn("grp", F.sum("apart").over(order))
    lines = F.array_sort(F.collect_list(F.struct("centre", "name")))
    return rows.groupBy("spec_id", "grp").agg(lines.alias("lines")).select("spec_id", "grp", F.transform("lines", lambda x: x["centre"]).alias("centres"), F.transform("lines", lambda x: x["name"]).alias("names"))


def _solve(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    """Amplitudes, the diagonal of the inverse Gram matrix and the sum of squares left, for rows of equal size."""
    gram = np.stack(rows["gram"].to_numpy()).astype(float).reshape(-1, n, n)
    side = np.stack(rows["side"].to_numpy()).astype(float)
    inverse = np.linalg.pinv(gram, rcond=1e-12, hermitian=True)
    amplitude = (inverse @ side[:, :, None])[:, :, 0]
    left = rows["square"].to_numpy() - (amplitude * side).sum(axis=1)
    return pd.DataFrame({"amplitudes": list(amplitude), "variances": list(np.clip(np.diagonal(inverse, axis1=1, axis2=2), 0, None)), "chi2": left}, index=rows.index)


def solve(gram: Column, side: Column, square: Column) -> Column:
    """struct(amplitudes, variances, chi2) of normal equations, row by row in batches of equal size."""

    @F.pandas_udf("amplitudes array<double>, variances array<double>, chi2 double")
    def run(gram: pd.Series, side: pd.Series, square: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame({"gram": gram, "side": side, "square": square})
        parts = [_solve(part, n) for n, part in rows.groupby(rows["side"].map(len))]
        return pd.concat(parts).loc[rows.index] if parts else pd.DataFrame({"amplitudes": [], "variances": [], "chi2": []})

    return run(gram, side, square)


def _gaussians(wavelength: Column, centres: Column, velocity: Column, resolution: float) -> Column:
    inside = (resolution / FWHM) ** 2
    return F.transform(centres, lambda c: F.exp(-0.5 * (wavelength - c) * (wavelength - c) / (inside + (c * velocity / LIGHT) * (c * velocity / LIGHT))))


def fit_lines(spectra: DataFrame, redshifts: DataFrame, names: list[str] | None = None, resolution: float = 5.0, velocities: tuple[float, float] = (30.0, 600.0)) -> DataFrame:
    """One row for each spectrum and line: flux, flux_error, equivalent_width, continuum, sigma, velocity_width, significance, detected, upper_limit, flags.

    ``spectra`` has a ``continuum`` column. Blended lines share one of 28 velocity widths, that with the least squares;
    a Balmer line alone in its group has a broad component under it for the stars' absorption. Errors come from
    the inverse Gram matrix, so members of a blend carry what they trade. Flags: outside_the_spectrum, width_at_search_limit,
    not_detected, blended, stellar_absorption_corrected.
    """
    names = list(LINES) if names is None else names
    groups = cut(line_groups(redshifts.filter("z IS NOT NULL"), names, resolution, velocities[1]))
    rows = spectra.filter("flux IS NOT NULL AND continuum IS NOT NULL AND NOT isnan(flux)").withColumn("residual", F.col("flux") - F.col("continuum"))
    step = F.col("wavelength") - F.lag("wavelength").over(Window.partitionBy("spec_id").orderBy("wavelength"))
    good = F.when((F.col("error") > 0) & ~F.isnan("error") & (F.col("error") < float("inf")), F.col("error"))
    middle = F.median("residual")
    whole = rows.withColumn("step", step).groupBy("spec_id").agg(F.median(good).alias("noise"), F.median("step").alias("dispersion"), middle.alias("middle"))
    spread = rows.join(whole, "spec_id").groupBy("spec_id").agg((1.4826 * F.median(F.abs(F.col("residual") - F.col("middle")))).alias("mad"))
    whole = whole.join(spread, "spec_id").select("spec_id", "dispersion", F.when(F.coalesce("noise", "mad") > 0, F.coalesce("noise", "mad")).otherwise(1.0).alias("noise"))
    groups = groups.join(whole, "spec_id")
    mean = F.aggregate("centres", F.lit(0.0), lambda s, c: s + c) / F.size("centres")
    groups = groups.withColumns({"mean": mean, "half": F.greatest(F.lit(4 * resolution) + F.array_max("centres") - F.array_min("centres"), 6 * F.col("dispersion"))})
    reach = F.col("half") + 6 * resolution
    placed = groups.withColumn("cell", F.explode(F.sequence(F.floor((F.col("mean") - reach) / CELL), F.floor((F.col("mean") + reach) / CELL))))
    near = rows.withColumn("cell", F.floor(F.col("wavelength") / CELL)).select("spec_id", "cell", "wavelength", "flux", "residual").join(placed, ["spec_id", "cell"])
    near = cut(near.withColumn("off", F.abs(F.col("wavelength") - F.col("mean"))).filter(F.col("off") < reach))

    # the continuum's level and noise beside the group
    beside = F.col("off") > F.col("half")
    enough = near.groupBy("spec_id", "grp").agg(F.count(F.when(beside, 1)).alias("n_beside"), F.count("*").alias("n_all"))
    band = near.join(enough, ["spec_id", "grp"]).filter((F.col("n_beside") < 5) & (F.col("n_all") >= 3) | beside & (F.col("n_beside") >= 5))
    level = band.groupBy("spec_id", "grp").agg(F.median("flux").alias("level"))
    noise = band.join(level, ["spec_id", "grp"]).groupBy("spec_id", "grp").agg(F.first("level").alias("level"), (1.4826 * F.median(F.abs(F.col("flux") - F.col("level")))).alias("level_noise"))

    # sums of products for every width: pixels of a group meet by aggregation
    alone = (F.size("names") == 1) & F.col("names")[0].isin(*BALMER)
    inside = near.filter(F.col("off") < F.col("half")).withColumn("velocity", F.explode(F.array(*[F.lit(float(x)) for x in np.linspace(*velocities, WIDTHS)])))
    basis = _gaussians(F.col("wavelength"), F.col("centres"), F.col("velocity"), resolution)
    basis = F.when(alone, F.concat(basis, _gaussians(F.col("wavelength"), F.col("centres"), F.lit(STELLAR), resolution))).otherwise(basis)
    inside = inside.withColumn("basis", basis)
    most = 1 + max(len(names), 1)
    sizes = groups.select(F.max(F.size("centres") + F.when(alone, 1).otherwise(0))).first()[0] or 1
    at = range(min(most, sizes))
    products = {(i, j): F.sum(F.get("basis", F.lit(i)) * F.get("basis", F.lit(j))).alias(f"p{i}_{j}") for i in at for j in at if i <= j}
    sums = inside.groupBy("spec_id", "grp", "velocity").agg(F.count("*").alias("n"), F.sum(F.col("residual") ** 2).alias("square"), F.max(F.size("basis")).alias("k"), *[F.sum(F.get("basis", F.lit(i)) * F.col("residual")).alias(f"s{i}") for i in at], *products.values())
    gram = F.flatten(F.slice(F.array(*[F.slice(F.array(*[F.col(f"p{min(i, j)}_{max(i, j)}") for j in at]), F.lit(1), F.col("k")) for i in at]), F.lit(1), F.col("k")))
    fitted = sums.select("spec_id", "grp", "velocity", "n", solve(gram, F.slice(F.array(*[F.col(f"s{i}") for i in at]), F.lit(1), F.col("k")), F.col("square")).alias("fit"))
    best = fitted.groupBy("spec_id", "grp").agg(F.max("n").alias("n"), F.min(F.struct(F.round("fit.chi2", 9).alias("r"), "velocity", "fit")).alias("best"))

    out = groups.join(best, ["spec_id", "grp"], "left").join(noise, ["spec_id", "grp"], "left")
    pixel_noise = F.when(F.col("level_noise") > 0, F.greatest("level_noise", F.col("noise") * 0.5)).otherwise(F.col("noise"))
    out = out.withColumns({"usable": F.coalesce(F.col("n") >= F.size("names") + 3, F.lit(False)), "pixel_noise": pixel_noise, "alone": alone, "several": F.size("names") > 1})
    out = out.select("*", F.posexplode("names").alias("i", "name")).withColumn("centre", F.col("centres")[F.col("i")])
    sigma = F.sqrt(F.lit((resolution / FWHM) ** 2) + (F.col("centre") * F.col("best.velocity") / LIGHT) ** 2)
    out = out.withColumn("sigma", F.when(F.col("usable"), sigma))
    area = F.sqrt(F.lit(2 * math.pi)) * F.col("sigma")
    out = out.withColumns({"flux": F.col("best.fit.amplitudes")[F.col("i")] * area, "flux_error": F.sqrt(F.col("best.fit.variances")[F.col("i")]) * F.col("pixel_noise") * area, "velocity_width": LIGHT * F.col("sigma") / F.col("centre")})
    out = out.withColumn("significance", F.when(F.col("flux_error") > 0, F.abs("flux") / F.col("flux_error")))
    limit = F.col("velocity_width") >= 0.98 * velocities[1]
    detected = F.coalesce((F.col("significance") >= DETECTED) & (F.col("flux") > 0) & ~limit, F.lit(False))
    trough = F.col("alone") & (F.get(F.col("best.fit.amplitudes"), F.lit(1)) < 0)
    flags = [("outside_the_spectrum", ~F.col("usable")), ("width_at_search_limit", F.col("usable") & limit), ("not_detected", F.col("usable") & ~F.col("detected")), ("blended", F.col("usable") & F.col("several")), ("stellar_absorption_corrected", F.col("usable") & trough)]
    out = out.withColumn("detected", detected)
    rest = F.element_at(F.create_map(*[F.lit(x) for kv in LINES.items() for x in kv]), F.col("name"))
    return out.select(
        "spec_id", "name", rest.alias("rest_wavelength"), F.when(F.col("usable"), F.col("centre")).alias("observed_wavelength"), "flux", "flux_error",
        F.when(F.col("usable") & (F.col("level") > 0), F.col("flux") / F.col("level")).alias("equivalent_width"), F.when(F.col("usable"), F.col("level")).alias("continuum"), "sigma", "velocity_width", "significance", "detected",
        F.when(F.col("usable") & ~F.col("detected"), DETECTED * F.col("flux_error")).alias("upper_limit"), F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in flags])).alias("flags"),
    )


def vote_linear(peaks: DataFrame, lines: list[float], tolerance: float = 6.0, scales: tuple[float, float] = (0.2, 40.0)) -> DataFrame:
    """(spec_id, scale, offset, hits, misfit): the line through two peaks and two catalog lines that places most peaks within ``tolerance``.

    ``peaks`` is (spec_id, centre). Every pair of peaks at least 0.15 of their range apart votes with every pair of lines; equal
    hits are settled by the smaller summed misfit, then by the earlier pair. A row is a spectrum's first peak of its pairs; the pairs, the
    lines and the hits are counted in its task, a bounded number at a time, so only one candidate for each first peak leaves it.
    """
    catalog = np.sort(np.array(lines, float))
    pairs = np.array([(a, b) for a in range(len(catalog)) for b in range(a + 1, len(catalog))], int).reshape(-1, 2)

    def votes(peaks: np.ndarray, i: int) -> list[tuple]:
        """The best candidate of the pairs whose first peak is ``i``, if there is one."""
        later = np.arange(i + 1, len(peaks))
        later = later[peaks[later] - peaks[i] >= 0.15 * max(peaks[-1] - peaks[0], 1.0)]
        best: list[tuple] = []
        size = max(1, MOST_VOTES // max(1, len(pairs) * len(peaks)))
        for j in (later[at : at + size] for at in range(0, len(later), size)):
            scale = (catalog[pairs[:, 1]] - catalog[pairs[:, 0]]) / (peaks[j] - peaks[i])[:, None]
            r, c = np.nonzero((scale >= scales[0]) & (scale <= scales[1]))
            if not len(r):
                continue
            scale, (a, b), j = scale[r, c], pairs[c].T, j[r]
            offset = catalog[a] - scale * peaks[i]
            placed = scale[:, None] * peaks + offset[:, None]
            right = np.clip(np.searchsorted(catalog, placed), 1, max(1, len(catalog) - 1))
            away = np.minimum(np.abs(placed - catalog[right - 1]), np.abs(placed - catalog[right]))
            hits, misfit = (away < tolerance).sum(axis=1), np.where(away < tolerance, away, 0.0).sum(axis=1)
            top = np.lexsort((b, a, j, np.round(misfit, 9), -hits))[0]
            best.append((int(-hits[top]), float(misfit[top]), i, int(j[top]), int(a[top]), int(b[top]), float(scale[top]), float(offset[top])))
        return sorted(best, key=lambda v: (v[0], round(v[1], 9), *v[2:6]))[:1]

    def run(parts):
        for part in parts:
            rows = [(s, *v) for s, p, i in zip(part["spec_id"], part["peaks"], part["i"], strict=True) for v in votes(np.asarray(p, float), int(i))]
            yield pd.DataFrame(rows, columns=["spec_id", "n", "misfit", "i", "j", "a", "b", "scale", "offset"])

    listed = peaks.groupBy("spec_id").agg(F.array_sort(F.collect_list("centre")).alias("peaks")).filter(F.size("peaks") >= 2)
    rows = listed.select("spec_id", "peaks", F.explode(F.sequence(F.lit(0), F.size("peaks") - 2)).alias("i")).repartition("spec_id", "i")
    kind = peaks.schema["spec_id"].dataType.simpleString()
    rows = rows.mapInPandas(run, f"spec_id {kind}, n int, misfit double, i int, j int, a int, b int, scale double, offset double")
    rank = F.struct("n", F.round("misfit", 9).alias("misfit"), "i", "j", "a", "b", "scale", "offset")
    best = rows.groupBy("spec_id").agg(F.min(rank).alias("best"))
    return best.select("spec_id", "best.scale", "best.offset", (-F.col("best.n")).cast("int").alias("hits"), "best.misfit")
