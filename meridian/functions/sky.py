"""Sky positions as Column expressions: separation, nested HEALPix pixels, projection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import clip


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle separation in degrees by Vincenty's formula, stable at all angles."""
    d = F.radians(ra2 - ra1)
    s1, c1, s2, c2 = F.sin(F.radians(dec1)), F.cos(F.radians(dec1)), F.sin(F.radians(dec2)), F.cos(F.radians(dec2))
    across = F.hypot(c2 * F.sin(d), c1 * s2 - s1 * c2 * F.cos(d))
    return F.degrees(F.atan2(across, s1 * s2 + c1 * c2 * F.cos(d)))


def unit_vector(ra: Column, dec: Column) -> list[Column]:
    a, d = F.radians(ra), F.radians(dec)
    return [F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)]


def _order(nside: int) -> int:
    if nside < 1 or nside & (nside - 1):
        raise ValueError(f"nside must be a power of two, got {nside}")
    return nside.bit_length() - 1


def _interleave(v: Column, bits: int) -> Column:
    """A zero between every two of the lowest bits."""
    one = F.lit(1).cast("long")
    return sum((F.shiftleft(F.shiftright(v, i).bitwiseAND(one), 2 * i) for i in range(bits)), F.lit(0).cast("long"))


def _squeeze(v: Column, bits: int) -> Column:
    """Every other bit."""
    one = F.lit(1).cast("long")
    return sum((F.shiftleft(F.shiftright(v, 2 * i).bitwiseAND(one), i) for i in range(bits)), F.lit(0).cast("long"))


def healpix(nside: int, ra: Column, dec: Column) -> Column:
    """Nested HEALPix pixel (Gorski et al. 2005) of a position in degrees."""
    bits = _order(nside)
    z = F.sin(F.radians(dec))
    turn = F.pmod(ra, F.lit(360.0)) / 90.0  # in [0, 4)

    # equatorial belt: lines of constant jp and jm cross at 45 degrees
    jp = F.floor(nside * (0.5 + turn) - nside * z * 0.75)
    jm = F.floor(nside * (0.5 + turn) + nside * z * 0.75)
    fp, fm = F.shiftright(jp, bits), F.shiftright(jm, bits)
    three = F.lit(3).cast("long")
    face = F.when(fp == fm, fp.bitwiseAND(three) + 4).when(fp < fm, fp.bitwiseAND(three)).otherwise(fm.bitwiseAND(three) + 8)
    inner = F.lit(nside - 1).cast("long")
    belt = [face, jm.bitwiseAND(inner), nside - jp.bitwiseAND(inner) - 1]

    # polar caps: distance to the pole sets the ring
    quarter = F.least(F.floor(turn), three)
    part, ring = turn - quarter, nside * F.sqrt(3 * (1 - F.abs(z)))
    a, b = F.least(F.floor(part * ring), inner), F.least(F.floor((1 - part) * ring), inner)
    north = z >= 0
    cap = [F.when(north, quarter).otherwise(quarter + 8), F.when(north, nside - b - 1).otherwise(a), F.when(north, nside - a - 1).otherwise(b)]

    face, x, y = (F.when(F.abs(z) <= 2.0 / 3.0, e).otherwise(c) for e, c in zip(belt, cap, strict=True))
    return F.shiftleft(face, 2 * bits) + _interleave(x, bits) + F.shiftleft(_interleave(y, bits), 1)


def with_healpix_centre(rows: DataFrame, nside: int, pixel: str, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """Adds a nested pixel's centre in degrees; the steps are columns of their own, so none is computed twice."""
    bits = _order(nside)
    within = F.col(pixel).bitwiseAND(F.lit(nside * nside - 1).cast("long"))
    names = rows.columns
    rows = rows.withColumns({"f_": F.shiftright(pixel, 2 * bits), "x_": _squeeze(within, bits), "y_": _squeeze(F.shiftright(within, 1), bits)})
    rows = rows.withColumn("ring_", (F.floor(F.col("f_") / 4) + 2) * nside - F.col("x_") - F.col("y_") - 1)
    ring = F.col("ring_")
    cap = (ring < nside) | (ring > 3 * nside)
    rows = rows.withColumns({
        "size_": F.when(ring < nside, ring).when(ring > 3 * nside, 4 * nside - ring).otherwise(F.lit(nside)),
        "shift_": F.when(cap, F.lit(0)).otherwise(F.pmod(ring - nside, F.lit(2))),
    })
    size, square = F.col("size_"), 3.0 * nside**2
    # face columns start at odd eighths of a turn in the caps and at even ones in the belt
    start = 2 * (F.col("f_") % 4) + F.when(F.floor(F.col("f_") / 4) == 1, 0).otherwise(1)
    rows = rows.withColumns({
        "z_": F.when(ring < nside, 1 - size * size / square).when(ring > 3 * nside, size * size / square - 1).otherwise((2 * nside - ring) * (2.0 / (3 * nside))),
        "step_": F.floor((start * size + F.col("x_") - F.col("y_") + 1 + F.col("shift_")) / 2),
    })
    step = F.when(F.col("step_") < 1, F.col("step_") + 4 * nside).when(F.col("step_") > 4 * nside, F.col("step_") - 4 * nside).otherwise(F.col("step_"))
    phi = F.degrees((step - (F.col("shift_") + 1) * 0.5) * (math.pi / 2) / size)
    return rows.select(*names, phi.alias(ra), F.degrees(F.asin(clip(F.col("z_"), -1, 1))).alias(dec))


def cell(ra: Column, dec: Column, degrees: float) -> tuple[Column, Column]:
    """Declination stripe and, within it, a right-ascension cell at least ``degrees`` wide (wraps at 360).

    The number of cells of a stripe comes from its edge nearest a pole, so a cone of radius ``degrees``
    touches only neighbouring cells of neighbouring stripes, however close the pole.
    """
    stripe = F.floor((dec + 90) / degrees)
    n = cells_of(stripe, degrees)
    return stripe, F.least(F.floor(F.pmod(ra, F.lit(360.0)) / 360 * n), n - 1)


def cells_of(stripe: Column, degrees: float) -> Column:
    far = F.greatest(F.abs(stripe * degrees - 90), F.abs((stripe + 1) * degrees - 90)) + degrees
    return F.greatest(F.floor(360 * F.cos(F.radians(F.least(far, F.lit(90.0)))) / (degrees * 1.01)), F.lit(1)).cast("long")


def gnomonic(ra: Column, dec: Column, ra0, dec0) -> tuple[Column, Column]:
    """Tangent-plane coordinates in degrees about (ra0, dec0)."""
    ra0, dec0 = (x if isinstance(x, Column) else F.lit(float(x)) for x in (ra0, dec0))
    d, a, a0 = F.radians(ra - ra0), F.radians(dec), F.radians(dec0)
    depth = F.sin(a0) * F.sin(a) + F.cos(a0) * F.cos(a) * F.cos(d)
    xi = F.cos(a) * F.sin(d) / depth
    eta = (F.cos(a0) * F.sin(a) - F.sin(a0) * F.cos(a) * F.cos(d)) / depth
    return F.when(depth > 0, F.degrees(xi)), F.when(depth > 0, F.degrees(eta))


def gnomonic_inverse(xi: Column, eta: Column, ra0: float, dec0: float) -> tuple[Column, Column]:
    x, y, a0 = F.radians(xi), F.radians(eta), math.radians(dec0)
    down = math.cos(a0) - y * math.sin(a0)
    ra = F.degrees(F.atan2(x, down)) + ra0
    dec = F.degrees(F.atan2(math.sin(a0) + y * math.cos(a0), F.hypot(x, down)))
    return F.pmod(ra, F.lit(360.0)), dec
