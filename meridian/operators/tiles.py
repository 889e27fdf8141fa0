"""All-pairs work on vectors (id, x): blocks of rows meet as tiles of bounded size.

Distances in a tile are found by matrix products with a bound on their error; whatever that error could decide is found again
from the differences of the vectors, so equal vectors are at distance 0 and both ends of a pair have the same distance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a tile's left side, and how many times as many are on its right side.
BLOCK, WIDE = 8192, 4
#: Blocks that a small left side is dealt into all the same, of this many rows at least.
SPREAD, LEAST = 16, 1024
#: Rows of a tile whose distances are held at a time, and pairs whose differences are.
ROWS, PIECE = 64, 1 << 16


def tiles(left: DataFrame, right: DataFrame, tile: Callable, schema: str, block: int = BLOCK) -> DataFrame:
    """``tile(left part, its vectors, right part, its vectors)`` for every pair of blocks of the two tables (id, x, ...)."""
    right = right.select(*[F.col(c).alias(f"right_{c}") for c in right.columns])  # the two may be one table
    size, other_size = left.count(), right.count()
    n, m = max(1, -(-size // block), min(SPREAD, size // LEAST)), max(1, -(-other_size // (block * WIDE)))

    def dealt(df: DataFrame, own: str, blocks: int, other: str, copies: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(df.columns[0]), F.lit(blocks))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))

    names = [c.split()[0] for c in schema.split(",")]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({c: [] for c in names})
        b = b.rename(columns=lambda c: c.removeprefix("right_"))
        return tile(a, np.stack(a["x"].to_numpy()).astype(float), b, np.stack(b["x"].to_numpy()).astype(float))

    return dealt(left, "i", n, "j", m).groupBy("i", "j").cogroup(dealt(right, "j", m, "i", n).groupBy("i", "j")).applyInPandas(run, schema)


def unit_of(x: np.ndarray, y: np.ndarray) -> float:
    """A power of two by which both sides' components are at most 1."""
    return float(2.0 ** np.frexp(max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)))[1])


def squares(x: np.ndarray, y: np.ndarray, unit: float) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, squared distances to y, each row's largest error) for some rows of x at a time, in units of ``unit`` squared."""
    x, y = x / unit, y / unit
    own, other = (x * x).sum(axis=1), (y * y).sum(axis=1)
    error = 4 * (x.shape[1] + 4) * np.finfo(float).eps * (own + other.max())
    for at in range(0, len(x), ROWS):
        rows = slice(at, min(at + ROWS, len(x)))
        found = (-2 * x[rows]) @ y.T
        found += other
        found += own[rows, None]
        yield rows, found, error[rows]


def exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the pairs (i, j) from the vectors' differences."""
    out = np.empty(len(i))
    for at in range(0, len(i), PIECE):
        away = x[i[at : at + PIECE]] - y[j[at : at + PIECE]]
        out[at : at + PIECE] = np.sqrt((away * away).sum(axis=1))
    return out


def distances(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """(rows, distances to all of y) for some rows of x at a time, to nine digits at least."""
    unit = unit_of(x, y)
    for rows, found, error in squares(x, y, unit):
        i, j = np.nonzero(found < 1e9 * error[:, None])
        np.maximum(found, 0, out=found)
        np.sqrt(found, out=found)
        found *= unit
        found[i, j] = exact(x[rows], y, i, j)
        yield rows, found


def nearest(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int, digits: int | None = None) -> pd.DataFrame:
    """id, other, dist of the k nearest other rows of y for each row of x; distances equal to ``digits`` decimals in order of id."""
    order = np.argsort(others)
    others, y = others[order], y[order]
    place = np.minimum(np.searchsorted(others, ids), len(others) - 1)
    same, unit, width, out = others[place] == ids, unit_of(x, y), len(y), []
    slack = 0.0 if digits is None else 2 * 10.0**-digits / unit
    # the k-th least of the least of groups of columns is no less than the k-th least of all
    deep = max(1, width // max(8 * k, 512))
    broad = width // deep
    for rows, found, error in squares(x, y, unit):
        mine = np.flatnonzero(same[rows])
        found[mine, place[rows][mine]] = np.inf
        least = found[:, : deep * broad].reshape(len(found), deep, broad).min(axis=1)
        bound = np.partition(least, min(k, broad) - 1, axis=1)[:, min(k, broad) - 1] if broad >= k else np.full(len(found), np.inf)
        limit = (np.sqrt(np.maximum(bound + error, 0)) + slack) ** 2 * (1 + 1e-12) + error
        i, j = np.nonzero((found <= limit[:, None]) & (found < np.inf))
        dist = exact(x[rows], y, i, j)
        order = np.lexsort((j, dist if digits is None else np.round(dist, digits), i))
        i, j, dist = i[order], j[order], dist[order]
        keep = (np.arange(len(i)) - np.searchsorted(i, i) < k) & np.isfinite(dist)
        out.append(pd.DataFrame({"id": ids[rows][i[keep]], "other": others[j[keep]], "dist": dist[keep]}))
    return pd.concat(out)


def close(x: np.ndarray, y: np.ndarray, eps: float) -> Iterator[tuple[slice, np.ndarray]]:
    """(rows, whether each row of y is at most ``eps`` away) for some rows of x at a time."""
    unit = unit_of(x, y)
    bound = (eps / unit) ** 2
    for rows, found, error in squares(x, y, unit):
        error = error + 1e-12 * bound
        near = found <= (bound - error)[:, None]
        i, j = np.nonzero((found <= (bound + error)[:, None]) & ~near)
        near[i, j] = exact(x[rows], y, i, j) <= eps
        yield rows, near
