"""Scalar Column functions: photometry, dates, angles, numerics and vectors. Null where undefined."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Solar absolute magnitude per band; "clear" is the default.
SOLAR_MAGNITUDE = {"u": 6.39, "g": 5.11, "r": 4.65, "i": 4.53, "z": 4.50, "B": 5.44, "V": 4.81, "R": 4.43, "I": 4.10, "clear": 4.74}
MJD_OFFSET = 2400000.5
POGSON = 2.5 / math.log(10)


def lit_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def finite(x: Column) -> Column:
    """x, or null for NaN and infinity."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def clip(x: Column, low: float, high: float) -> Column:
    """x within bounds; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def magnitude(flux: Column, zero_point: float = 25.0) -> Column:
    return F.when(flux > 0, zero_point - 2.5 * F.log10(flux))


def magnitude_error(flux: Column, flux_err: Column) -> Column:
    return F.when(flux > 0, POGSON * flux_err / flux)


def flux_of(mag: Column, zero_point: float = 25.0) -> Column:
    return F.pow(F.lit(10.0), (zero_point - mag) / 2.5)


def snr_of(mag_err: Column) -> Column:
    return F.when(mag_err > 0, POGSON / mag_err)


def limiting_magnitude(rms: Column, radius: Column, zero_point: float = 25.0, sigma: float = 5.0) -> Column:
    flux = sigma * rms * F.sqrt(math.pi * F.pow(F.greatest(radius, F.lit(1e-6)), F.lit(2.0)))
    return F.when(flux > 0, zero_point - 2.5 * F.log10(flux))


def surface_brightness(flux: Column, area_pixels: Column, pixel_scale: float = 1.0, zero_point: float = 25.0) -> Column:
    area = area_pixels * pixel_scale**2
    return F.when((flux > 0) & (area > 0), zero_point - 2.5 * F.log10(flux / area))


def dimming(z: Column) -> Column:
    """Surface-brightness factor at a redshift."""
    return F.pow(1 + z, F.lit(-4.0))


def sum_magnitudes(mag: Column) -> Column:
    """Aggregate: magnitude of the total flux."""
    return -2.5 * F.log10(F.sum(F.pow(F.lit(10.0), -0.4 * mag)))


def colour_temperature(colour: Column, pair: tuple[str, str] = ("g", "r")) -> Column:
    """Black-body temperature from B-V, other pairs converted first."""
    bv = {("g", "r"): 0.98 * colour + 0.22, ("V", "R"): 1.8 * colour}.get(pair, colour)
    bv = 0.92 * clip(bv, -0.4, 2.0)
    return 4600.0 * (1 / (bv + 1.7) + 1 / (bv + 0.62))


def distance_modulus(parsec: Column) -> Column:
    return F.when(parsec > 0, 5 * F.log10(parsec / 10))


def absolute_magnitude(mag: Column, parsec: Column, extinction: float = 0.0) -> Column:
    return mag - distance_modulus(parsec) - extinction


def solar_luminosity(absolute: Column, band: Column) -> Column:
    solar = F.coalesce(lit_map(SOLAR_MAGNITUDE)[band], F.lit(SOLAR_MAGNITUDE["clear"]))
    return F.pow(F.lit(10.0), -0.4 * (absolute - solar))


def mjd_to_jd(mjd: Column) -> Column:
    return mjd + MJD_OFFSET


def jd_to_mjd(jd: Column) -> Column:
    return jd - MJD_OFFSET


def mjd_to_timestamp(mjd: Column) -> Column:
    return F.timestamp_micros(F.round((mjd - 40587) * 86400e6).cast("long"))


def safe_divide(a: Column, b: Column, fill: float | None = None) -> Column:
    """a / b, ``fill`` (null by default) where b is nearly zero or a side is missing."""
    out = F.when(F.abs(b) > 1e-12, a / b)
    return out if fill is None else F.coalesce(out, F.lit(float(fill)))


def logistic(x: Column, scale: float = 1.0, midpoint: float = 0.0) -> Column:
    return 1 / (1 + F.exp(-clip((x - midpoint) / scale, -60, 60)))


def softmax(scores: Column) -> Column:
    """Softmax of an array of doubles."""
    top = F.array_max(scores)
    exps = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(exps, F.lit(0.0), lambda a, x: a + x)
    return F.transform(exps, lambda e: e / total)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """L2-normalised; a zero vector is left alone."""
    n = norm(a)
    return F.when(n > 1e-12, F.transform(a, lambda x: x / n)).otherwise(a.cast("array<double>"))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def horner(x: Column, coefficients: list) -> Column:
    """Polynomial with the highest power first."""
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + c
    return out


def log_odds(p: Column, epsilon: float = 1e-6) -> Column:
    q = clip(p, epsilon, 1 - epsilon)
    return F.log(q / (1 - q))
