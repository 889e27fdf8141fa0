"""Least squares from aggregated sums: Spark adds the normal equations, the driver solves a few unknowns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sky import gnomonic


def solve(rows: DataFrame, terms: list[Column], target: Column) -> np.ndarray:
    """Coefficients of ``target`` on ``terms`` over all rows, from one aggregation."""
    k = len(terms)
    sums = [F.sum(terms[i] * terms[j]) for i in range(k) for j in range(i, k)] + [F.sum(t * target) for t in terms]
    got = [x or 0.0 for x in rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
    a, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = got[at]
            at += 1
    return np.linalg.lstsq(a, np.array(got[at:]), rcond=None)[0]


def polynomial(rows: DataFrame, x: str, y: str, degree: int, clip_sigma: float = 2.5, rounds: int = 4) -> tuple[np.ndarray, float]:
    """Robust polynomial (highest power first) and its scatter: rows beyond ``clip_sigma`` scaled MADs go, round by round."""
    from ..functions.columns import horner

    kept, before = rows.select(F.col(x).cast("double").alias("x_"), F.col(y).cast("double").alias("y_")).filter("x_ IS NOT NULL AND y_ IS NOT NULL"), -1
    for _ in range(rounds + 1):
        powers = [F.pow("x_", F.lit(float(degree - i))) for i in range(degree + 1)]
        c = solve(kept, powers, F.col("y_"))
        residual = F.col("y_") - horner(F.col("x_"), [float(v) for v in c])
        n, middle = kept.agg(F.count("*"), F.median(residual)).first()
        scatter = 1.4826 * (kept.agg(F.median(F.abs(residual - F.lit(middle)))).first()[0] or 0.0)
        if n == before or scatter == 0:
            break
        before, kept = n, kept.filter(F.abs(residual - F.lit(middle)) <= clip_sigma * scatter)
    return c, scatter


def plate_solution(pairs: DataFrame, ra0: float, dec0: float) -> dict:
    """Affine map from measured (ra, dec) to reference (rra, rdec) tangent coordinates, and its rms."""
    x, y = gnomonic(F.col("ra"), F.col("dec"), ra0, dec0)
    u, w = gnomonic(F.col("rra"), F.col("rdec"), ra0, dec0)
    rows = pairs.select(x.alias("x"), y.alias("y"), u.alias("u"), w.alias("w"))
    terms = [F.lit(1.0), F.col("x"), F.col("y")]
    a, b = solve(rows, terms, F.col("u")), solve(rows, terms, F.col("w"))

    def model(c):
        return float(c[0]) + float(c[1]) * F.col("x") + float(c[2]) * F.col("y")

    rms = rows.agg(F.sqrt(F.avg(F.pow(F.col("u") - model(a), F.lit(2.0)) + F.pow(F.col("w") - model(b), F.lit(2.0))))).first()[0]
    return {"u": a.tolist(), "w": b.tolist(), "rms_arcsec": 3600 * (rms or 0.0)}
