"""Light curves kept as rows (object, mjd, flux, flux_err): variability, shape, folding and periods.

Every statistic is one grouped aggregation over columns computed in one ordered window, so a curve is shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip

MAD_SIGMA = 1.4826
#: Trial frequencies in a row of the matrix that ``periods`` sums.
FINE = 64


def clean(curves: DataFrame) -> DataFrame:
    """Epochs with a finite time and flux."""
    ok = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in ("mjd", "flux")]
    return curves.filter(ok[0] & ok[1])


def normalise(curves: DataFrame, key: str) -> DataFrame:
    """Fluxes over the curve's median flux; zero where the median is nearly zero."""
    m = F.median("flux").over(Window.partitionBy(key))
    safe = F.abs(m) > 1e-12
    return clean(curves).withColumns({"norm_flux": F.when(safe, F.col("flux") / m).otherwise(0.0), "norm_err": F.when(safe, F.col("flux_err") / F.abs(m))})


def _prepared(curves: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows with the curve's size, mean, median, deviations and the difference and product with the epoch before."""
    w = Window.partitionBy(key)
    n, mean, sd = F.count("flux").over(w), F.avg("flux").over(w), F.stddev_pop("flux").over(w)
    rows = clean(curves).withColumns({"n_": n, "mean_": mean, "sd_": sd, "median_": F.median("flux").over(w), "t0_": F.min("mjd").over(w)})
    delta = F.sqrt(F.col("n_") / F.greatest(F.col("n_") - 1, F.lit(1))) * (F.col("flux") - F.col("mean_")) / F.greatest("flux_err", F.lit(1e-9))
    rows = rows.withColumn("delta_", delta)
    before = Window.partitionBy(key).orderBy(*order)
    return rows.withColumns({"step_": F.col("flux") - F.lag("flux").over(before), "pair_": F.col("delta_") * F.lag("delta_").over(before), "dev_": F.abs(F.col("flux") - F.col("median_"))})


def variability(curves: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Fifteen variability features per curve; null where a curve is too short for one."""
    rows = _prepared(curves, key, order)
    good = F.col("flux_err") > 0
    w = F.when(good, 1 / (F.col("flux_err") * F.col("flux_err")))
    n, flux = F.count("flux"), F.col("flux")
    chi2 = (F.sum(w * flux * flux) - F.sum(w * flux) * F.sum(w * flux) / F.sum(w)) / F.greatest(F.count(w) - 1, F.lit(1))
    mean, var = F.avg("flux"), F.var_samp("flux")
    excess = var - F.avg(F.col("flux_err") * F.col("flux_err"))
    sd = F.stddev_pop("flux")

    def z(power):
        return F.avg(F.pow((flux - F.col("mean_")) / F.col("sd_"), F.lit(float(power))))

    def least(k, value: Column) -> Column:
        return F.when(n >= k, value)

    flat = sd <= 1e-12
    return rows.groupBy(key).agg(
        n.cast("double").alias("n_epochs"),
        (F.max("mjd") - F.min("mjd")).alias("baseline"),
        mean.alias("mean_flux"),
        F.median("flux").alias("median_flux"),
        sd.alias("std_flux"),
        least(2, MAD_SIGMA * F.median("dev_")).alias("mad"),
        F.when(F.count(w) >= 2, chi2).alias("reduced_chi2"),
        least(4, F.avg(F.signum("pair_") * F.sqrt(F.abs("pair_")))).alias("stetson_j"),
        F.when((n >= 3) & (F.abs(mean) >= 1e-12), F.sqrt(F.greatest(excess, F.lit(0.0))) / F.abs(mean)).alias("fractional_variability"),
        least(3, F.percentile("flux", F.lit(0.95)) - F.percentile("flux", F.lit(0.05))).alias("amplitude"),
        least(3, F.when(flat, 0.0).otherwise(z(3))).alias("skewness"),
        least(4, F.when(flat, 0.0).otherwise(z(4) - 3)).alias("kurtosis"),
        least(3, F.when(flat, 0.0).otherwise(F.avg((F.abs(flux - F.col("mean_")) > F.col("sd_")).cast("double")))).alias("beyond_1std"),
        F.when((n >= 3) & (var > 1e-12), F.avg(F.col("step_") * F.col("step_")) / var).alias("von_neumann_eta"),
        F.when((n >= 3) & (F.max("mjd") > F.min("mjd")), F.regr_slope("flux", F.col("mjd") - F.col("t0_"))).alias("linear_trend"),
    )


def variability_score(threshold: float = 3.0) -> Column:
    """Mean of the votes that a curve's features allow, 0 without any."""
    votes = F.array_compact(
        F.array(
            F.least(F.col("reduced_chi2") / threshold, F.when(F.col("reduced_chi2").isNotNull(), 1.0)),
            clip(F.col("stetson_j") / threshold, 0, 1),
            clip(F.col("fractional_variability") / 0.05, -1e308, 1),
            clip((2.0 - F.col("von_neumann_eta")) / 1.2, 0, 1),
        )
    )
    total = F.aggregate(votes, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(votes) > 0, clip(total / F.size(votes), 0, 1)).otherwise(0.0)


def variable_class(score: Column, period: Column | None = None, fap: Column | None = None) -> Column:
    """Triage label: non_variable, eclipsing, periodic_pulsator, eruptive, secular_trend or stochastic."""
    periodic = F.lit(False) if period is None else F.coalesce(period.isNotNull() & (fap < 0.01), F.lit(False))
    skew = F.col("skewness")
    eruptive = (skew > 1.0) & (F.col("von_neumann_eta") < 1.0)
    drift = (F.abs("mean_flux") > 1e-9) & (F.abs("linear_trend") * F.greatest("baseline", F.lit(1e-9)) > 0.25 * F.abs("mean_flux"))
    return (
        F.when(score < 0.3, "non_variable")
        .when(periodic & F.coalesce(skew < -0.7, F.lit(False)), "eclipsing")
        .when(periodic, "periodic_pulsator")
        .when(F.coalesce(eruptive, F.lit(False)), "eruptive")
        .when(F.coalesce(drift, F.lit(False)), "secular_trend")
        .otherwise("stochastic")
    )


def most_variable(curves: DataFrame, key: str, order: list[str], limit: int) -> DataFrame:
    """The curves with the largest variability score, ties by key."""
    scored = variability(curves, key, order).withColumn("score", variability_score())
    return scored.select(key, "n_epochs", "reduced_chi2", "stetson_j", "von_neumann_eta", "score").orderBy(F.round("score", 6).desc(), key).limit(limit)


def shape(curves: DataFrame, key: str) -> DataFrame:
    """Peak, rise and decline rates of curves with three epochs and a positive peak."""
    first, last = F.min_by("flux", "mjd"), F.max_by("flux", "mjd")
    peak = F.max(F.struct(F.col("flux"), -F.col("mjd")))
    out = clean(curves).groupBy(key).agg(F.count("*").cast("double").alias("n_epochs"), F.min("mjd").alias("t0"), F.max("mjd").alias("t1"), first.alias("f0"), last.alias("f1"), peak.alias("top"), F.median("flux").alias("base"))
    flux, when = F.col("top.flux"), -F.col("top.col2")
    rise = F.when(when > F.col("t0"), (flux - F.col("f0")) / (when - F.col("t0")))
    fall = F.when(F.col("t1") > when, (flux - F.col("f1")) / (F.col("t1") - when))
    out = out.filter((F.col("n_epochs") >= 3) & (flux > 0))
    return out.select(
        key, rise.alias("rise_rate"), fall.alias("decline_rate"), when.alias("peak_time"),
        ((flux - F.col("base")) / F.greatest(F.abs(flux), F.lit(1e-9))).alias("peak_fraction"),
        F.when(F.abs(fall) > 1e-9, rise / F.abs(fall)).alias("asymmetry"), "n_epochs",
    )


def phase_fold(curves: DataFrame, key: str, period: Column) -> DataFrame:
    """Adds the phase of each epoch, counted from the curve's first one."""
    t = F.col("mjd") - F.min("mjd").over(Window.partitionBy(key))
    return clean(curves).withColumn("phase", F.when(period > 0, F.pmod(t / period, F.lit(1.0))))


def periods(curves: DataFrame, key: str, n_frequencies: int = 2000, min_period: float = 0.02, max_period: float = 100.0, oversample: float = 5.0) -> DataFrame:
    """Weighted Lomb-Scargle peak of each curve with five epochs: frequency, period, power, false-alarm probability.

    A curve is shuffled once, and its points come to the sums of all trial frequencies batch by batch, so neither a whole curve
    nor its points times the frequencies are held or shuffled; only the peak leaves the task.
    """
    w = Window.partitionBy(key)
    rows = clean(curves).withColumns({"n_": F.count("*").over(w), "base_": F.max("mjd").over(w) - F.min("mjd").over(w), "t_": F.col("mjd") - F.min("mjd").over(w)})
    rows = rows.filter((F.col("n_") >= 5) & (F.col("base_") > 0))
    usable = F.min(F.col("flux_err") > 0).over(w)
    rows = rows.withColumn("w_", F.when(usable, 1 / (F.col("flux_err") * F.col("flux_err"))).otherwise(1.0))
    rows = rows.withColumn("w_", F.col("w_") / F.sum("w_").over(w))
    rows = rows.withColumn("y_", F.col("flux") - F.sum(F.col("w_") * F.col("flux")).over(w))
    longest = F.least(F.lit(float(max_period)), 2 * F.col("base_"))
    low = F.greatest(1 / F.greatest(longest, F.lit(1e-6)), 1 / (oversample * F.col("base_")))
    high = F.when(F.lit(1 / min_period) <= low, low * 10).otherwise(F.lit(1 / min_period))
    n = max(16, n_frequencies)
    points = rows.filter("w_ IS NOT NULL AND y_ IS NOT NULL").select(key, "n_", "t_", "w_", "y_", low.alias("low_"), ((high - low) / (n - 1)).alias("step_"))

    def peak(group: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = doubled = square = 0.0
        for b in batches:
            t, w, y = (b[c].to_numpy(float) for c in ("t_", "w_", "y_"))
            if len(b):
                size, start, step = int(b["n_"].iat[0]), float(b["low_"].iat[0]), float(b["step_"].iat[0])
            # trial 64 i + j turns by the product of two rotations, so the sums over points are matrix products
            first, coarse, fine = np.exp(2j * np.pi * start * t), np.exp(2j * np.pi * step * np.outer(t, FINE * np.arange(-(-n // FINE)))), np.exp(2j * np.pi * step * np.outer(t, np.arange(FINE)))
            plain = plain + ((w * y * first)[:, None] * coarse).T @ fine
            doubled = doubled + ((w * first**2)[:, None] * coarse**2).T @ fine**2
            square += (w * y * y).sum()
        plain, doubled = plain.ravel()[:n], doubled.ravel()[:n]
        # with the doubled-angle sums, the tau-shifted sums follow from the plain ones
        half, r = 0.5 * np.angle(doubled), np.abs(doubled)
        cc, ss = 0.5 * (1 + r), 0.5 * (1 - r)
        c, s = plain.real * np.cos(half) + plain.imag * np.sin(half), plain.imag * np.cos(half) - plain.real * np.sin(half)
        power = np.where(cc > 1e-12, c * c / np.maximum(cc, 1e-12), 0.0) + np.where(ss > 1e-12, s * s / np.maximum(ss, 1e-12), 0.0)
        power = np.zeros(n) if square <= 0 else np.clip(np.nan_to_num(power / square, nan=1.0), 0, 1)
        k = int(np.argmax(power))
        beside = [power[i] if 0 <= i < n else None for i in (k - 1, k + 1)]
        yield pd.DataFrame([(group[0], power[k], k, *beside, start, step, size)], columns=[key, "power", "k", "y0", "y2", "low", "step", "n"])

    best = points.groupBy(key).applyInPandas(peak, f"{key} {curves.schema[key].dataType.simpleString()}, power double, k int, y0 double, y2 double, low double, step double, n long")
    bend = F.col("y0") - 2 * F.col("power") + F.col("y2")
    shift = F.coalesce(F.when(F.abs(bend) > 1e-12, clip(0.5 * (F.col("y0") - F.col("y2")) / bend, -1, 1)), F.lit(0.0))
    frequency = F.col("low") + (F.col("k") + shift) * F.col("step")
    single = F.pow(1 - F.least("power", F.lit(1 - 1e-12)), (F.col("n") - 3) / 2.0)
    alarm = clip(1 - F.pow(1 - single, F.lit(float(n))), 0, 1)
    return best.select(key, frequency.alias("frequency"), (1 / frequency).alias("period"), "power", alarm.alias("false_alarm_probability"), F.col("n").cast("double").alias("n_epochs"))


def encode(curves: DataFrame, key: str, order: list[str], length: int = 64) -> DataFrame:
    """Arrays of ``length`` steps of (normalised flux, time since the step before over the baseline, validity).

    Short curves are padded with zeros, longer ones interpolated on an even time grid.
    """
    w = Window.partitionBy(key)
    rows = normalise(curves, key).withColumns({"n_": F.count("*").over(w), "t_": F.col("mjd") - F.min("mjd").over(w), "base_": F.max("mjd").over(w) - F.min("mjd").over(w)})
    o = w.orderBy(*order)
    rows = rows.withColumns({"i_": F.row_number().over(o) - 1, "gap_": F.coalesce(F.col("t_") - F.lag("t_").over(o), F.lit(0.0)), "next_t": F.lead("t_").over(o), "next_f": F.lead("norm_flux").over(o)})
    base = F.greatest("base_", F.lit(1e-9))
    short = rows.filter(F.col("n_") <= length).select(key, F.col("i_").alias("step"), F.col("norm_flux").alias("f"), (F.col("gap_") / base).alias("g"))
    grid = F.col("base_") / (length - 1)
    low = F.when(F.col("i_") == 0, F.lit(0)).otherwise(F.ceil(F.col("t_") / grid - 1e-9).cast("int"))
    high = F.when(F.col("next_t").isNull(), F.lit(length - 1)).otherwise((F.ceil(F.col("next_t") / grid - 1e-9) - 1).cast("int"))
    long_ = rows.filter(F.col("n_") > length).withColumns({"low_": low, "high_": high}).filter("low_ <= high_")
    long_ = long_.withColumn("step", F.explode(F.sequence("low_", "high_")))
    along = (F.col("step") * grid - F.col("t_")) / (F.col("next_t") - F.col("t_"))
    value = F.when(F.col("next_t").isNull() | (F.col("next_t") == F.col("t_")), F.col("norm_flux")).otherwise(F.col("norm_flux") + along * (F.col("next_f") - F.col("norm_flux")))
    long_ = long_.select(key, "step", value.alias("f"), F.when(F.col("step") == 0, 0.0).otherwise(1.0 / (length - 1)).alias("g"))
    steps = short.unionByName(long_).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("step", F.struct("f", "g")))).alias("m"))
    at = F.sequence(F.lit(0), F.lit(length - 1))
    def part(field: str) -> Column:
        return F.transform(at, lambda i: F.coalesce(F.element_at("m", i)[field], F.lit(0.0)))

    mask = F.transform(at, lambda i: F.map_contains_key("m", i).cast("double"))
    return steps.select(key, part("f").alias("flux_steps"), part("g").alias("gap_steps"), mask.alias("mask"))


def last_before(points: DataFrame, key: str, when: str, detected: Column) -> DataFrame:
    """Per object, the newest non-detection before ``when`` (a column)."""
    return points.filter(~detected & (F.col("mjd") < F.col(when))).groupBy(key).agg(F.max("mjd").alias("last_limit_mjd"), F.max_by("band", "mjd").alias("last_limit_band"))
