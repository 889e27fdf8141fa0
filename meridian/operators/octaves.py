"""Counts of pairs of positions by octaves of their distance, without a row for each pair.

Equal positions are one spot with a weight. Spots go into square tiles; a tile meets its own spots and those of the neighbours ahead
that lie within the radius of its edge, in parts of bounded size. In a task spots are sorted along a space-filling curve into groups:
two groups whose boxes leave their pairs one octave count as the product of their weights, only the others are gone through.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import cut

#: Sides of a tile in radii, spots of a part at most (about), spots of a group, and pairs whose distances are held at a time.
TILE, PART, GROUP, HELD = 4, 1 << 16, 32, 1 << 18
#: Last places of a squared distance below a power of four in which the rounding of root and logarithm may reach the next octave.
DOUBT = 4096
#: Neighbours of a tile that it meets; it is met by the others.
AHEAD = ((1, 0), (-1, 1), (0, 1), (1, 1))


def octave_of(squared: float) -> int:
    """floor(log2(distance)) with each step rounded as SQL engines round it."""
    return math.floor(math.log2(math.sqrt(squared)))


def _octaves(squared: np.ndarray) -> np.ndarray:
    """``octave_of`` of each positive squared distance."""
    bits = squared.view(np.int64)
    out = ((bits >> 52) - 1023) >> 1
    doubt = (bits & ((1 << 52) - 1)) >= (1 << 52) - DOUBT
    doubt |= bits < (1 << 52)  # without an exponent of their own
    if doubt.any():
        values, where = np.unique(squared[doubt], return_inverse=True)
        out[doubt] = np.array([octave_of(v) for v in values.tolist()])[where]
    return out


class _Groups:
    """Spots in groups of neighbours; the last is filled up with spots of no weight."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray):
        low, span = (x.min(), y.min()), max(np.ptp(x), np.ptp(y)) or 1.0
        key = np.zeros(len(x), np.int64)
        for axis, v in enumerate((x, y)):
            at = ((v - low[axis]) / span * 65535).astype(np.int64)
            for bit in range(16):
                key |= ((at >> bit) & 1) << (2 * bit + axis)
        order = np.argsort(key, kind="stable")
        fill = -len(x) % GROUP
        order = np.r_[order, np.repeat(order[-1:], fill)]
        self.x, self.y, self.w = (v[order].reshape(-1, GROUP) for v in (x, y, w))
        self.w.ravel()[len(x) :] = 0
        self.total = self.w.sum(axis=1)
        self.box = [(v.min(axis=1), v.max(axis=1)) for v in (self.x, self.y)]


def _count(a: _Groups, b: _Groups, radius: float, same: bool) -> Counter:
    """Pairs by octave of their distance, 0 left out; with ``same`` of the spots of one side, each pair once."""
    out, limit = Counter(), radius * radius
    while math.sqrt(np.nextafter(limit, np.inf)) <= radius:
        limit = np.nextafter(limit, np.inf)
    while math.sqrt(limit) > radius:
        limit = np.nextafter(limit, 0)

    def add(octaves, n, half=False):
        at, where = np.unique(octaves, return_inverse=True) if len(octaves) else ([], [])
        sums = np.zeros(len(at), np.int64)
        np.add.at(sums, where, n)
        for k, s in zip(at, sums, strict=True):
            out[int(k)] += int(s) // 2 if half else int(s)

    def through(i, j, half=False):
        step = max(1, HELD // GROUP**2)
        for at in range(0, len(i), step):
            p, q = i[at : at + step], j[at : at + step]
            d = a.x[p][:, :, None] - b.x[q][:, None, :]
            d *= d
            dy = a.y[p][:, :, None] - b.y[q][:, None, :]
            dy *= dy
            d += dy
            n = a.w[p][:, :, None] * b.w[q][:, None, :]
            d, n = d.ravel(), n.ravel()
            near = (d > 0) & (d <= limit)
            d, n = d[near], n[near]
            if len(d):
                octaves = _octaves(d)
                least = int(octaves.min())
                sums = np.bincount(octaves - least, n)  # exact below 2**53
                for k in np.flatnonzero(sums):
                    out[least + int(k)] += int(sums[k]) // 2 if half else int(sums[k])

    rows = max(1, HELD // len(b.total))
    for at in range(0, len(a.total), rows):
        some = slice(at, at + rows)
        near, far = 0.0, 0.0
        for (a_low, a_high), (b_low, b_high) in zip(a.box, b.box, strict=True):
            ahead, behind = b_low - a_high[some, None], a_low[some, None] - b_high
            near = near + np.maximum(np.maximum(ahead, behind), 0) ** 2
            far = far + np.maximum(b_high - a_low[some, None], a_high[some, None] - b_low) ** 2
        near, far = near * (1 - 1e-9), far * (1 + 1e-9)
        reach = near <= limit
        if same:
            reach &= np.arange(len(b.total)) > np.arange(at, at + len(near))[:, None]
        i, j = np.nonzero(reach)
        near, far = near[i, j], far[i, j]
        one = (near > 1e-300) & (far <= limit)
        one[one] = _octaves(near[one]) == _octaves(far[one])
        add(_octaves(near[one]), a.total[at + i[one]] * b.total[j[one]])
        through(at + i[~one], j[~one])
    if same:
        every = np.arange(len(a.total))
        through(every, every, half=True)
    return out


def octave_counts(points: DataFrame, radius: float, within: tuple[str, ...] = ()) -> DataFrame:
    """(bin, dd): pairs of points (x, y) at most ``radius`` apart by floor(log2(distance)), those at distance 0 left out.

    With ``within`` only pairs that agree in those columns count. Points without a finite position are in no pair.
    """
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("x", "y")]
    spots = points.filter(finite[0] & finite[1]).groupBy(*within, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.count("*").alias("w"))
    side = TILE * radius
    place = {c: F.col(c) / side - F.col(f"t{c}") for c in ("x", "y")}  # in its tile, from 0 to 1
    spots = cut(spots.withColumns({"tx": F.floor(F.col("x") / side), "ty": F.floor(F.col("y") / side)}).withColumns({"fx": place["x"], "fy": place["y"]}))
    tile, edge = [*within, "tx", "ty"], 1.01 / TILE

    def close(axis: str, step: int):
        return F.lit(True) if step == 0 else F.col(f"f{axis}") <= edge if step > 0 else F.col(f"f{axis}") >= 1 - edge

    met = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("meets")), *[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (close("x", i) & close("y", j)).alias("meets")) for i, j in AHEAD])
    right = spots.withColumn("d", F.explode(met)).filter("d.meets").select(*within, (F.col("tx") - F.col("d.i")).alias("tx"), (F.col("ty") - F.col("d.j")).alias("ty"), ((F.col("d.i") == 0) & (F.col("d.j") == 0)).alias("own"), "x", "y", "w")
    right = cut(right)  # and a table of its own, so that the two sides' columns are not the same
    parts = cut(right.groupBy(*tile).agg(F.max("own").alias("own"), F.ceil(F.count("*") / PART).alias("parts")).filter("own").drop("own"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        return df.join(parts, tile).withColumn(own, F.pmod(F.xxhash64("x", "y"), F.col("parts"))).withColumn(other, every).drop("parts")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = Counter()
        if len(a) and len(b):
            i, j = b["i"].iat[0], b["j"].iat[0]
            left = _Groups(*(a[c].to_numpy() for c in "xyw"))
            for own, part in b.groupby("own"):
                if not own or i < j:
                    out += _count(left, _Groups(*(part[c].to_numpy() for c in "xyw")), radius, False)
                elif i == j:
                    out += _count(left, left, radius, True)
        return pd.DataFrame({"bin": list(out), "n": list(out.values())}, dtype=np.int64)

    left = dealt(spots.select(*tile, "x", "y", "w"), "i", "j").groupBy(*tile, "i", "j")
    counts = left.cogroup(dealt(right, "j", "i").groupBy(*tile, "i", "j")).applyInPandas(run, "bin long, n long")
    return counts.groupBy(F.col("bin").cast("int").alias("bin")).agg(F.sum("n").alias("dd"))


def pair_counts(points: DataFrame, radius: float) -> DataFrame:
    """(bin, dd): ``octave_counts`` of points (id, x, y), in which rows of equal id are no pair and rows without one are in none."""
    known = points.filter("id IS NOT NULL")
    again = cut(known.groupBy("id").count().filter("count > 1").select("id"))
    counts = octave_counts(known, radius)
    if again.isEmpty():
        return counts
    fewer = octave_counts(known.join(again, "id"), radius, ("id",))
    both = counts.unionByName(fewer.withColumn("dd", -F.col("dd")))
    return both.groupBy("bin").agg(F.sum("dd").alias("dd")).filter("dd > 0")
