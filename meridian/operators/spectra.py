"""Spectra as rows (spec_id, pix, wavelength, flux, error): continuum, peaks, line matching, diagnostics."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.columns import horner


def _middle(ordered: np.ndarray) -> float:
    """Median of sorted numbers as Spark takes it, NaN being the largest."""
    low, high = ordered[(len(ordered) - 1) // 2], ordered[len(ordered) // 2]
    return low if low == high else 0.5 * low + 0.5 * high


def running_median(values: np.ndarray, there: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Medians over 2 half + 1 places of the values that are there, and where such a window has any."""
    place, ranks = np.flatnonzero(there), np.full(len(values) + 2 * half, len(values), np.int32)
    order = place[np.argsort(values[place], kind="stable")]
    ranks[half + order] = np.arange(len(order), dtype=np.int32)
    ordered = np.append(values[order], np.nan)
    total = np.concatenate([[0], np.cumsum(there)])
    at = np.arange(len(values))
    counts = total[np.minimum(at + half + 1, len(values))] - total[np.maximum(at - half, 0)]
    out, windows = np.empty(len(values)), np.lib.stride_tricks.sliding_window_view(ranks, 2 * half + 1)
    for start in range(0, len(values), 1024):
        part = slice(start, start + 1024)
        inside, n = np.sort(windows[part], axis=1), counts[part]
        r = np.arange(len(inside))
        low, high = (ordered[np.minimum(inside[r, k], len(order))] for k in (np.maximum(n - 1, 0) // 2, n // 2))
        out[part] = np.where(low == high, low, 0.5 * low + 0.5 * high)
    return out, counts > 0


def continuum(spectra: DataFrame, half: int = 75, rounds: int = 3, sigma: float = 1.5) -> DataFrame:
    """Running median over 2 half + 1 pixels; pixels above it by ``sigma`` scaled MADs are replaced, round by round.

    A spectrum is sorted once and goes through all rounds in its task: medians of sliding windows are ranks, not maps of values.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table["pix"], null_placement="at_start"))
        there = pc.is_valid(table["flux"]).to_numpy()
        work = table["flux"].cast(pa.float64()).to_numpy().copy()
        for _ in range(rounds):
            level, some = running_median(work, there, half)
            if not there.any():
                break
            above = work - level
            spread = sigma * (1.4826 * _middle(np.sort(np.abs(above[there]))))
            # as in Spark, NaN is above every number
            over = there & ((above > spread) | np.isnan(above) & ~np.isnan(spread))
            work = np.where(over, level, work)
        return table.append_column("continuum", pa.array(level, pa.float64(), mask=~some))

    schema = StructType([*spectra.schema.fields, StructField("continuum", DoubleType())])
    return spectra.groupBy("spec_id").applyInArrow(run, schema)


def peaks(spectra: DataFrame, sigma: float = 1.0) -> DataFrame:
    """Pixels not below their neighbours and above the spectrum's median by ``sigma`` scaled MADs, with a parabola's sub-pixel shift."""
    whole, o = Window.partitionBy("spec_id"), Window.partitionBy("spec_id").orderBy("pix")
    rows = spectra.withColumns({"m": F.median("flux").over(whole), "f0": F.lag("flux").over(o), "f2": F.lead("flux").over(o)})
    rows = rows.withColumn("mad", 1.4826 * F.median(F.abs(F.col("flux") - F.col("m"))).over(whole))
    top = (F.col("flux") - F.col("m") > sigma * F.col("mad")) & (F.col("flux") >= F.col("f0")) & (F.col("flux") > F.col("f2"))
    bend = F.col("f0") - 2 * F.col("flux") + F.col("f2")
    shift = F.coalesce(0.5 * (F.col("f0") - F.col("f2")) / F.nullif(bend, F.lit(0.0)), F.lit(0.0))
    return rows.filter(top).select("spec_id", "pix", (F.col("pix") + shift).alias("centre"), "wavelength", "flux")


def match_lines(found: DataFrame, lines: DataFrame, tolerance: float) -> DataFrame:
    """Mutual nearest (spec_id, pix, line) within a tolerance; both sides meet in wavelength cells."""
    near = F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("d")
    cell = F.floor(F.col("line") / tolerance)
    right = lines.select("line", near).select("line", (cell + F.col("d")).alias("cell"))
    pairs = found.withColumn("cell", F.floor(F.col("wavelength") / tolerance)).join(right, "cell").withColumn("off", F.abs(F.col("wavelength") - F.col("line"))).filter(F.col("off") <= tolerance)
    order = F.round("off", 9)
    pairs = pairs.withColumns({"i": F.row_number().over(Window.partitionBy("spec_id", "pix").orderBy(order, "line")), "j": F.row_number().over(Window.partitionBy("spec_id", "line").orderBy(order, "pix"))})
    return pairs.filter("i = 1 AND j = 1").select("spec_id", "pix", "line", "off")


def balmer_reddening(ratio: Column, intrinsic: float = 2.86) -> Column:
    """E(B-V) of an H alpha to H beta ratio; 0 at or below the intrinsic one."""
    return F.when(ratio > intrinsic, 2.5 / (3.61 - 2.53) * F.log10(ratio / intrinsic)).when(ratio.isNotNull(), 0.0)


def zero_point(pairs: DataFrame, rounds: int = 4, sigma: float = 3.0) -> tuple[float, float, int]:
    """Median offset of catalog minus instrumental magnitudes with clipping, its error and the number kept."""
    kept, before = pairs.select((F.col("catalog_mag") - F.col("mag")).alias("d")).filter("d IS NOT NULL"), -1
    for _ in range(rounds + 1):
        n, m = kept.agg(F.count("*"), F.median("d")).first()
        if n == before or not n:
            break
        spread = 1.4826 * kept.agg(F.median(F.abs(F.col("d") - m))).first()[0]
        before, kept = n, kept.filter(F.abs(F.col("d") - m) <= max(sigma * spread, 1e-12))
    rms = kept.agg(F.stddev_pop("d")).first()[0] or 0.0
    return m, rms / max(1, n) ** 0.5, n


def sky_line_offsets(spectra: DataFrame, lines: DataFrame, window: float, isolation: float) -> DataFrame:
    """(spec_id, n_lines, offset, scatter, reliable): flux-weighted centroids of isolated lines against where they should be.

    ``lines`` is a short list; lines with a neighbour nearer than ``isolation`` and windows below five pixels are left out.
    """
    o = Window.orderBy("line")
    gap = F.least(F.col("line") - F.lag("line").over(o), F.lead("line").over(o) - F.col("line"))
    alone = lines.distinct().withColumn("gap", gap).filter(F.coalesce(F.col("gap") >= isolation, F.lit(True)))
    cell = F.floor(F.col("line") / window)
    alone = alone.select("line", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    p = spectra.withColumn("cell", F.floor(F.col("wavelength") / window)).join(F.broadcast(alone), "cell").filter(F.abs(F.col("wavelength") - F.col("line")) < window)
    w = Window.partitionBy("spec_id", "line")
    p = p.withColumns({"m": F.median("flux").over(w), "n": F.count("*").over(w)}).withColumn("w", F.greatest(F.col("flux") - F.col("m"), F.lit(0.0)))
    c = p.filter("n >= 5").groupBy("spec_id", "line").agg(F.sum("w").alias("total"), F.sum(F.col("w") * F.col("wavelength")).alias("at")).filter("total > 0")
    c = c.withColumn("shift", F.col("at") / F.col("total") - F.col("line")).filter(F.abs("shift") <= 0.6 * window)
    c = c.withColumn("away", F.abs(F.col("shift") - F.median("shift").over(Window.partitionBy("spec_id"))))
    return c.groupBy("spec_id").agg(F.count("*").alias("n_lines"), F.median("shift").alias("offset"), F.when(F.count("*") > 2, 1.4826 * F.median("away")).alias("scatter"), (F.count("*") >= 3).alias("reliable"))


#: Signal to noise of a detected line, sigmas of an upper limit, and the published dividing lines (slope, pole, offset).
DETECTED, LIMIT_SIGMA = 3.0, 3.0
EMPIRICAL, THEORETICAL, SEYFERT = (0.61, 0.05, 1.30), (0.61, 0.47, 1.19), (1.05, 0.45)


def line_ratio(top: tuple[Column, Column], bottom: tuple[Column, Column]) -> Column:
    """struct(value, error, status) of two (flux, error) lines; a ratio with an undetected line is a limit, with two there is none."""
    (f, df), (g, dg) = top, bottom
    up, low = F.coalesce(f >= DETECTED * df, F.lit(False)), F.coalesce(g >= DETECTED * dg, F.lit(False))
    status = F.when(up & low, "measured").when(low, "upper_limit").when(up, "lower_limit").otherwise("unavailable")
    value = F.when(up & low, f / g).when(low, LIMIT_SIGMA * df / g).when(up, f / (LIMIT_SIGMA * dg))
    error = F.when(up & low, F.abs(f / g) * F.sqrt((df / f) ** 2 + (dg / g) ** 2))
    return F.struct(value.alias("value"), error.alias("error"), status.alias("status"))


def _boundary(x: Column, line: tuple[float, float, float]) -> Column:
    slope, pole, offset = line
    return F.when(x < pole, slope / (x - pole) + offset).otherwise(float("-inf"))


def diagnostic_class(rows: DataFrame, oxygen: str, nitrogen: str) -> DataFrame:
    """Add log ratios, the region of the diagram and whether it is sure; ``oxygen`` and ``nitrogen`` are line_ratio columns."""
    usable = (F.col(oxygen)["value"] > 0) & (F.col(nitrogen)["value"] > 0)
    y, x = (F.when(usable, F.log10(F.col(c)["value"])) for c in (oxygen, nitrogen))
    rows = rows.withColumns({"log_o3_hb": y, "log_n2_ha": x})
    x, y = F.col("log_n2_ha"), F.col("log_o3_hb")
    first, second = _boundary(x, EMPIRICAL), _boundary(x, THEORETICAL)
    kind = F.when(x.isNull(), "unclassified").when(y < first, "star-forming").when(y < second, "composite").when(y > SEYFERT[0] * x + SEYFERT[1], "Seyfert").otherwise("LINER")
    spread = F.sqrt(sum((F.coalesce(F.col(c)["error"] / (F.col(c)["value"] * F.log(F.lit(10.0))), F.lit(0.0)) ** 2 for c in (oxygen, nitrogen)), F.lit(0.0)))
    distance = F.least(F.abs(y - first), F.abs(y - second))
    measured = (F.col(oxygen)["status"] == "measured") & (F.col(nitrogen)["status"] == "measured")
    sure = measured & (distance < float("inf")) & (distance > F.greatest(2 * spread, F.lit(0.05)))
    return rows.withColumns({"region": kind, "confident": F.coalesce(sure, F.lit(False))})


def wavelength_axis(spectra: DataFrame, coefficients: list[float], first: float, last: float) -> DataFrame:
    """Wavelengths as a polynomial of the pixel, highest power first; pixels outside the fitted range are marked."""
    pix = F.col("pix").cast("double")
    return spectra.withColumns({"wavelength": horner(pix, coefficients), "extrapolated": (pix < first) | (pix > last)})


def shifted(spectra: DataFrame, z: float, low: float, high: float) -> DataFrame:
    """The spectra as seen at redshift ``z``, cut to a wavelength range."""
    wavelength = F.col("wavelength") * (1 + z)
    return spectra.withColumn("wavelength", wavelength).filter(F.col("wavelength").between(low, high))


def spectrum_summary(spectra: DataFrame) -> DataFrame:
    """Per spectrum: pixels, median signal to noise and median wavelength step."""
    step = F.col("wavelength") - F.lag("wavelength").over(Window.partitionBy("spec_id").orderBy("pix"))
    return spectra.withColumn("step", step).groupBy("spec_id").agg(F.count("*").alias("n"), F.median(F.col("flux") / F.col("error")).alias("snr"), F.median("step").alias("dispersion"))


#: Rest wavelengths in Angstrom of the emission lines that a redshift is read from.
EMISSION = {"[O II]": 3727.4, "H beta": 4861.3, "[O III] 5007": 5006.8, "H alpha": 6562.8, "[N II] 6584": 6583.5}


def emission_redshift(spectra: DataFrame, least: float = 5.0) -> DataFrame:
    """(spec_id, z, n_lines, lines) from (spec_id, wavelength, excess), where excess is the normalised flux less one.

    Trial redshifts a fifth of a step apart are scored by the positive excess at all lines in range, two at least; the
    lines found are those above ``least`` times the noise near their places. z is null with fewer than two found.
    A spectrum meets in one task; the trials stay inside it.
    """
    names, rest = list(EMISSION), np.array(list(EMISSION.values()))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        key, none = part["spec_id"].iloc[0], {"z": None, "n_lines": 0, "lines": ""}
        part = part.dropna(subset=["wavelength", "excess"]).sort_values("wavelength")
        w, e = part["wavelength"].to_numpy(), part["excess"].to_numpy()
        if len(w) < 3:
            return pd.DataFrame([{"spec_id": key, **none}])
        noise, step = 1.4826 * np.median(np.abs(e - np.median(e))), float(np.median(np.diff(w)))
        trials = np.arange(max(w[0] / rest.max() - 1, 0), w[-1] / rest.min() - 1, 0.2 * step / np.median(rest)) if noise > 0 else np.empty(0)
        places = rest * (1 + trials[:, None])
        inside = (places > w[0]) & (places < w[-1])
        scores = (np.clip(np.interp(places, w, e), 0, None) * inside).sum(axis=1) * (inside.sum(axis=1) >= 2)
        if not len(scores) or scores.max() <= 0:
            return pd.DataFrame([{"spec_id": key, **none}])
        z = float(trials[int(np.argmax(np.round(scores, 9)))])
        at = rest * (1 + z)
        near = np.abs(w - at[:, None]) < max(3 * step, 6.0)
        high = np.where(near, e, -np.inf).max(axis=1) > least * noise
        found = [n for n, h, c in zip(names, high, at, strict=True) if h and w[0] < c < w[-1]]
        return pd.DataFrame([{"spec_id": key, "z": z if len(found) > 1 else None, "n_lines": len(found), "lines": "|".join(found)}])

    return spectra.groupBy("spec_id").applyInPandas(one, "spec_id long, z double, n_lines int, lines string")
