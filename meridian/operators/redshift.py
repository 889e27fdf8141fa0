"""Redshifts by cross-correlation with templates, and velocity dispersions by broadening them.

Continua are windows in Spark; each spectrum then is one row of arrays, correlated in batches with a template library of bounded size.
Peaks, rivals, flags and the choice between templates are columns again.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rounds import cut
from .spectra import EMISSION, continuum, emission_redshift

LIGHT = 299792.458
#: R of a real match, lead over a rival, km/s within which two redshifts agree, velocity of a star, least usable pixels.
LEAST_R, LEAD, AGREE, STAR_VELOCITY, LEAST_PIXELS = 7.0, 1.3, 600.0, 3000.0, 100
#: Redshift differences of a rival peak and of another template's answer; lags needed beside a peak.
RIVAL_APART, OTHER_APART, LEAST_LAGS = 0.02, 0.01, 30
#: Fixed value: noise that a continuum must exceed so many times to be divided by.
LEAST_CONTINUUM = 3.0
#: The library comes to the driver and is sent to every task: more templates are an error.
MOST_TEMPLATES = 500


def flatten(spectra: DataFrame, key: str = "spec_id", half: int = 75) -> DataFrame:
    """(key, pix, wavelength, value, good): flux over its continuum less one; 0 and not good where the continuum is lost in noise."""
    rows = spectra.withColumnRenamed(key, "spec_id") if key != "spec_id" else spectra
    rows = continuum(rows, half, 4)
    usable = F.col("flux").isNotNull() & ~F.isnan("flux")
    error = F.when((F.col("error") >= 0) & (F.col("error") < float("inf")), F.col("error"))
    noise = F.coalesce(F.median(error).over(Window.partitionBy("spec_id")), F.lit(0.0))
    rows = rows.withColumn("noise", noise)
    value = F.when(usable & (F.col("continuum") >= LEAST_CONTINUUM * F.col("noise")) & (F.col("continuum") != 0), F.col("flux") / F.col("continuum") - 1)
    out = rows.withColumn("value", value).select("spec_id", "pix", "wavelength", F.coalesce("value", F.lit(0.0)).alias("value"), usable.alias("good"))
    return out.withColumnRenamed("spec_id", key)


def _arrays(flat: DataFrame, key: str, *extra: str) -> DataFrame:
    points = F.array_sort(F.collect_list(F.struct("wavelength", "value")))
    rows = flat.filter("good").groupBy(key, *extra).agg(points.alias("points"))
    return rows.select(key, *extra, F.transform("points", lambda p: p["wavelength"]).alias("w"), F.transform("points", lambda p: p["value"]).alias("v"))


def log_grid(low: float, high: float, velocity: float = 50.0) -> np.ndarray:
    """Wavelengths a fixed velocity apart."""
    ratio = 1 + velocity / LIGHT
    return low * ratio ** np.arange(max(2, math.ceil(math.log(high / low) / math.log(ratio)) + 1))


def prepare(w: np.ndarray, v: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Values on the grid (0 outside), their outer tenths tapered, over their deviation."""
    out = np.interp(grid, w, v, left=0.0, right=0.0)
    edge = max(1, len(grid) // 10)
    ramp = 0.5 - 0.5 * np.cos(np.pi * np.arange(edge) / edge)
    out[:edge] *= ramp
    out[-edge:] *= ramp[::-1]
    spread = out.std()
    return out / spread if spread > 0 else out


def correlate(observed: np.ndarray, templates: np.ndarray) -> np.ndarray:
    """Normalised correlation of one spectrum with each template at every lag, from 1 - n to n - 1."""
    n = len(observed)
    size = 1 << (2 * n - 1).bit_length()
    c = np.fft.irfft(np.fft.rfft(observed, size) * np.conj(np.fft.rfft(templates, size)), size)
    c = np.concatenate([c[:, size - n + 1 :], c[:, :n]], axis=1)
    norm = np.sqrt((observed**2).sum() * (templates**2).sum(axis=1))[:, None]
    return np.divide(c, norm, out=c, where=norm > 0)


def antisymmetric_r(c: np.ndarray, peak: int) -> float:
    """Height of a peak over sqrt(2) times the root mean square of the correlation's antisymmetric part about it."""
    filled = np.flatnonzero(np.abs(c) > 1e-12)
    if len(filled) < 2 * LEAST_LAGS or not filled[0] <= peak <= filled[-1]:
        return math.nan
    reach = min(peak - filled[0], filled[-1] - peak)
    if reach < LEAST_LAGS:
        return math.nan
    odd = 0.5 * (c[peak + 1 : peak + reach + 1] - c[peak - reach : peak][::-1])
    noise = math.sqrt((odd**2).mean())
    return c[peak] / (math.sqrt(2) * noise) if noise > 0 else math.nan


def template_peaks(w: np.ndarray, v: np.ndarray, library: list[tuple], z_range: tuple[float, float], velocity: float) -> list[tuple]:
    """(template, kind, z, r, second_r) for each (name, kind, wavelengths, values) of the library that has lags in range."""
    grid = log_grid(w[0] / (1 + max(z_range[1], 0.0)), w[-1], velocity)
    n, step, out = len(grid), math.log(grid[1] / grid[0]), []
    z = np.expm1(np.arange(1 - n, n) * step)
    found = correlate(prepare(w, v, grid), np.stack([prepare(tw, tv, grid) for _, _, tw, tv in library]))
    for (name, kind, _, _), c in zip(library, found, strict=True):
        inside = (z >= z_range[0]) & (z <= z_range[1])
        if kind == "star":
            inside &= np.abs(z) <= STAR_VELOCITY / LIGHT
        at = np.flatnonzero(inside)
        if not len(at):
            continue
        peak = int(at[np.argmax(c[at])])
        rivals = at[np.abs(z[at] - z[peak]) > RIVAL_APART]
        second = antisymmetric_r(c, int(rivals[np.argmax(c[rivals])])) if len(rivals) else math.nan
        shift = 0.0
        if 0 < peak < len(c) - 1:
            left, middle, right = c[peak - 1 : peak + 2]
            bend = left - 2 * middle + right
            shift = float(np.clip(0.5 * (left - right) / bend, -1, 1)) if bend else 0.0
        out.append((name, kind, float(np.expm1((peak - (n - 1) + shift) * step)), antisymmetric_r(c, peak), second))
    return out


def correlation_peaks(spectra: DataFrame, templates: DataFrame, z_range: tuple[float, float] = (-0.005, 1.2), velocity: float = 50.0) -> DataFrame:
    """(spec_id, template, kind, z, r, second_r): the best lag of every template for each spectrum of enough usable pixels.

    ``templates`` is (template, kind, pix, wavelength, flux, error), a library of at most MOST_TEMPLATES.
    """
    flat = _arrays(flatten(templates.withColumn("name_", F.struct("template", "kind")), "name_"), "name_").limit(MOST_TEMPLATES + 1).collect()
    if len(flat) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    library = sorted((str(r.name_.template), str(r.name_.kind), np.array(r.w), np.array(r.v)) for r in flat) if flat else []
    schema = "spec_id long, template string, kind string, z double, r double, second_r double"

    def run(parts):
        for part in parts:
            rows = [(s, *p) for s, w, v in zip(part["spec_id"], part["w"], part["v"], strict=True) for p in (template_peaks(np.array(w), np.array(v), library, z_range, velocity) if library else [])]
            yield pd.DataFrame(rows, columns=["spec_id", "template", "kind", "z", "r", "second_r"])

    rows = _arrays(flatten(spectra), "spec_id").filter(F.size("w") >= LEAST_PIXELS)
    found = rows.mapInPandas(run, schema)
    return found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("r", "second_r")})


def redshifts(spectra: DataFrame, templates: DataFrame, z_range: tuple[float, float] = (-0.005, 1.2), velocity: float = 50.0) -> DataFrame:
    """One row a spectrum: z, z_error, r, template, is_star, method, second_z, peak_ratio, z_emission, n_emission_lines, reliable, flags.

    The template with the highest R wins; the correlation stands if R reaches 7 and leads its own rival peak by 1.3, or if emission
    lines agree with it; where it fails, two emission lines that agree stand by themselves.
    """
    peaks = cut(correlation_peaks(spectra, templates, z_range, velocity))
    order = F.struct(F.coalesce(F.col("r"), F.lit(float("-inf"))).alias("o"))
    first = peaks.groupBy("spec_id").agg(F.max_by(F.struct("template", "kind", "z", "r", "second_r"), F.struct(order, F.col("template"))).alias("top"))
    others = peaks.join(first, "spec_id").filter(F.abs(F.col("z") - F.col("top.z")) > OTHER_APART)
    second = others.groupBy("spec_id").agg(F.max_by("z", F.struct(F.coalesce(F.col("r"), F.lit(-1.0)), F.col("template"))).alias("second_z"))
    flat = continuum(spectra, 50, 4)
    flat = flat.select("spec_id", "wavelength", (F.col("flux") / F.nullif("continuum", F.lit(0.0)) - 1).alias("excess"))
    lines = emission_redshift(flat).select("spec_id", F.col("z").alias("z_emission"), F.col("n_lines").alias("n_emission_lines"), "lines")
    step = F.col("wavelength") - F.lag("wavelength").over(Window.partitionBy("spec_id").orderBy("pix"))
    base = spectra.withColumn("step", step).groupBy("spec_id").agg(F.count(F.when(F.col("flux").isNotNull() & ~F.isnan("flux"), 1)).alias("n_good"), F.median("step").alias("dispersion"))
    rows = base.join(first, "spec_id", "left").join(second, "spec_id", "left").join(lines, "spec_id", "left")
    r, z = F.col("top.r"), F.col("top.z")
    names = F.create_map(*[F.lit(x) for kv in EMISSION.items() for x in kv])
    found = F.split("lines", r"\|")
    mean_line = F.aggregate(F.transform(found, lambda n: F.coalesce(F.try_element_at(names, n), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x) / F.size(found)
    rows = rows.withColumns({
        "few": F.col("n_good") < LEAST_PIXELS,
        "low": ~F.coalesce(r >= LEAST_R, F.lit(False)),
        "lined": F.col("z_emission").isNotNull() & (F.col("n_emission_lines") >= 2),
        "peak_ratio": F.when(F.col("top.second_r") > 0, r / F.col("top.second_r")),
        "apart": F.abs(F.col("z_emission") - z) * LIGHT / (1 + z),
    })
    rival = ~F.col("low") & F.coalesce(F.col("peak_ratio") < LEAD, F.lit(False))
    rows = rows.withColumns({"rival": rival, "settled": F.col("lined") & F.coalesce(F.col("apart") < AGREE, F.lit(False)), "against": ~F.col("low") & ~rival & F.col("lined") & F.coalesce(F.col("apart") > AGREE, F.lit(False))})
    by_lines = F.col("low") & F.col("lined") & ~F.col("few")
    reliable = ~F.col("few") & F.when(F.col("low"), F.col("lined")).when(F.col("rival"), F.col("settled")).otherwise(~F.col("against"))
    error = F.when(by_lines, 0.3 * F.col("dispersion") / mean_line).when(r > 0, (1 + z) * (3 * velocity / LIGHT) / (1 + r))
    flags = [("too_few_pixels", F.col("few")), ("low_correlation", ~F.col("few") & F.col("low")), ("rival_peak", F.col("rival")), ("emission_absorption_disagree", F.col("against"))]
    return rows.select(
        "spec_id", F.when(by_lines, F.col("z_emission")).otherwise(z).alias("z"), error.alias("z_error"), r.alias("r"), F.col("top.template").alias("template"), F.coalesce(F.col("top.kind") == "star", F.lit(False)).alias("is_star"),
        F.when(by_lines, "emission lines").when(z.isNotNull(), "cross-correlation").alias("method"), "second_z", "peak_ratio", "z_emission", "n_emission_lines", reliable.alias("reliable"),
        F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in flags])).alias("flags"),
    )


def dispersions(spectra: DataFrame, known: DataFrame, template: DataFrame, resolution: float = 5.0, step: float = 25.0) -> DataFrame:
    """(spec_id, fitted_width, sigma, instrumental, reliable) in km/s of spectra with a redshift in ``known`` (spec_id, z).

    One template (pix, wavelength, flux, error) is shifted to each spectrum's redshift and broadened to 25 widths; the least squares
    choose, the instrument's width is taken off in quadrature, and a width not above it is no measurement.
    """
    rest = _arrays(flatten(template.withColumn("spec_id", F.lit(0).cast("long"))), "spec_id").first()
    tw, tv = np.array(rest.w), np.array(rest.v)
    widths = np.arange(0.0, 500.0, 20.0)

    def run(parts):
        for part in parts:
            out = []
            for s, z, w, v in zip(part["spec_id"], part["z"], part["w"], part["v"], strict=True):
                grid = log_grid(w[0], w[-1], step)
                observed, shifted = prepare(np.array(w), np.array(v), grid), prepare(tw * (1 + z), tv, grid)
                for width in widths:
                    model = shifted
                    if width > 0:
                        size = int(max(4 * width / step, 3)) | 1
                        kernel = np.exp(-0.5 * ((np.arange(size) - size // 2) * step / width) ** 2)
                        model = np.convolve(shifted, kernel / kernel.sum(), mode="same") if size <= len(shifted) else shifted * 0
                    if model.std() > 0:
                        scale = (observed @ model) / (model @ model)
                        out.append((s, width, ((observed - scale * model) ** 2).sum()))
            yield pd.DataFrame(out, columns=["spec_id", "width", "chi2"])

    rows = _arrays(flatten(spectra), "spec_id").filter(F.size("w") >= LEAST_PIXELS).join(known.select("spec_id", "z").filter("z IS NOT NULL"), "spec_id")
    tried = rows.select("spec_id", "z", "w", "v").mapInPandas(run, "spec_id long, width double, chi2 double")
    best = tried.groupBy("spec_id").agg(F.min_by("width", F.struct(F.round("chi2", 9), "width")).alias("fitted_width"))
    instrument = LIGHT * resolution / 2.3548 / 5000
    resolved = F.col("fitted_width") > instrument
    return best.select("spec_id", "fitted_width", F.when(resolved, F.sqrt(F.col("fitted_width") ** 2 - instrument**2)).alias("sigma"), F.lit(instrument).alias("instrumental"), resolved.alias("reliable"))
