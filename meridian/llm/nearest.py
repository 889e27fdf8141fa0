"""Nearest neighbours by inner product: a block matrix join with quantised tiles and exact survivors.

Every vector is scaled by a power of two, so that no square overflows or vanishes, and coded in int8. Queries and
candidates are dealt into blocks; every pair of a query block and a candidate block is one tile, held by one
task, and only codes, scales and norms travel to it. There int8 products (exact integers) bound each inner
product from both sides; pairs whose upper bound is below the query's k-th lower bound, first of the
tile and then of all tiles, are dropped. The survivors meet their original vectors, are computed anew in double
precision, in component order, and go into one heap of k a query.

Defined cases: rows with a null id or a null, empty, zero or non-finite vector take no part; vectors of
another length never meet; rows with the query's own id are not its candidates; repeated rows are candidates
each and as queries count once; ties go to the smaller vec_id; fewer candidates than k give all of them, an
empty table gives an empty result. Products that may overflow in double precision are never dropped by bounds; one that is
not a number ranks before all others, as Spark sorts it. Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K, EVERY = 20, 20
#: Rows of a query block and components (rows times dimensions) of a candidate block; rows of a product.
QUERY_BLOCK, BLOCK_COMPONENTS, TILE = 4096, 2_000_000, 4096


def usable(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """vec_id, vector (doubles), dim of the rows that take part."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    return vectors.filter(F.col("vec_id").isNotNull() & F.col(vec).isNotNull() & fine).select(F.col("vec_id").cast("long"), F.col(vec).cast("array<double>").alias("vector"), F.size(vec).alias("dim"))


def quantise(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """int8 codes, their scales, norms of the rest that the codes leave, norms, and the exponent of two that vectors are divided by."""
    exponent = np.frexp(np.abs(x).max(axis=1))[1]
    x = np.ldexp(x, -exponent[:, None])
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(x - codes * scale[:, None], axis=1), np.linalg.norm(x, axis=1), exponent


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed in component order."""
    out = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for d in range(a.shape[1]):
            out += a[:, d] * b[:, d]
    return out


def _vectors(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def coded(rows: DataFrame) -> DataFrame:
    """The rows with their code, scale, rest, norm and exponent."""
    names = [*rows.columns, "code", "scale", "rest", "norm", "exponent"]

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                code, scale, rest, norm, exponent = quantise(_vectors(part.column("vector"), dim))
                more = [pa.array([c.tobytes() for c in code], pa.binary()), *map(pa.array, (scale, rest, norm)), pa.array(exponent.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=names)

    kinds = "row long, vec_id long, vector array<double>, dim int, code binary, scale double, rest double, norm double, exponent int"
    return rows.mapInArrow(run, kinds)


def bounds(q: pd.DataFrame, x: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products of two blocks."""
    a, b = (np.frombuffer(b"".join(part["code"]), np.int8).reshape(len(part), -1) for part in (q, x))
    kind = np.float32 if a.shape[1] <= 1000 else np.float64  # sums of int8 products below 2^24 are exact
    (q_scale, q_rest, q_norm), (scale, rest, norm) = ([part[c].to_numpy() for c in ("scale", "rest", "norm")] for part in (q, x))
    near = (a.astype(kind) @ b.astype(kind).T).astype(np.float64) * (q_scale[:, None] * scale)
    slack = q_rest[:, None] * (norm + rest) + q_norm[:, None] * rest + 1e-9 * q_norm[:, None] * norm
    power = q["exponent"].to_numpy()[:, None] + x["exponent"].to_numpy()
    least = 5e-324 * a.shape[1]  # what products that vanish may lose
    with np.errstate(over="ignore"):
        low, high = np.ldexp(near - slack, power) - least, np.ldexp(near + slack, power) + least
        vast = np.ldexp(q_norm[:, None] * norm, power) > 1e300
    low[vast], high[vast] = -np.inf, np.inf
    return low, high


def _tile(k: int):
    columns = ["query_row", "row", "low", "high"]

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for b in range(0, len(queries), TILE // 8):
            q = queries.iloc[b : b + TILE // 8]
            best, mine = np.full((len(q), k), -np.inf), []
            for a in range(0, len(rows), TILE):
                x = rows.iloc[a : a + TILE]
                low, high = bounds(q, x)
                own = q["vec_id"].to_numpy()[:, None] == x["vec_id"].to_numpy()
                low[own] = -np.inf
                best = np.concatenate([best, low], axis=1)
                best = np.partition(best, -k, axis=1)[:, -k:]
                i, j = np.nonzero((high >= best.min(axis=1)[:, None]) & ~own)
                mine.append((i, x["row"].to_numpy()[j], low[i, j], high[i, j]))
            if mine:
                i, row, low, high = (np.concatenate(c) for c in zip(*mine, strict=True))
                keep = high >= best.min(axis=1)[i]
                found.append(pd.DataFrame(dict(zip(columns, (q["row"].to_numpy()[i[keep]], row[keep], low[keep], high[keep]), strict=True))))
        return pd.concat(found) if found else pd.DataFrame({c: [] for c in columns})

    return run


def _heaps(k: int):
    """The k best of each query, whose rows are in one partition."""

    def run(batches):
        heaps: dict[int, list] = {}
        query_ids = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                score = inner(_vectors(part.column("q"), dim), _vectors(part.column("x"), dim))
                ids = [part.column(c).to_pylist() for c in ("query_row", "query_id", "vec_id")]
                for row, query, other, value in zip(*ids, score.tolist(), strict=True):
                    query_ids[row] = query
                    heap, item = heaps.setdefault(row, []), (value != value, 0.0 if value != value else value, -other)
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)
        out = [(query_ids[row], n, -other, float("nan") if odd else value) for row, heap in heaps.items() for n, (odd, value, other) in enumerate(sorted(heap, reverse=True), 1)]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "rank", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, query_block: int = QUERY_BLOCK, components: int = BLOCK_COMPONENTS) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows of each query (vec_id divisible by ``every``)."""
    numbered = usable(vectors).select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector", "dim")
    rows = materialize(coded(numbered), "coded")
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "vector").agg(F.min("row").alias("row"))
    queries = rows.join(queries.select("row"), "row", "left_semi")
    row_blocks, query_blocks = -(-n * dim // components) or 1, -(-n // (every * query_block)) or 1
    sent, mixed = ["row", "vec_id", "dim", "code", "scale", "rest", "norm", "exponent"], F.xxhash64("row")

    def all_blocks(count):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    left = queries.select(*sent, F.pmod(mixed, F.lit(query_blocks)).alias("qb"), all_blocks(row_blocks).alias("rb"))
    right = rows.select(*sent, F.pmod(mixed, F.lit(row_blocks)).alias("rb"), all_blocks(query_blocks).alias("qb"))
    left, block = left.toDF(*left.columns), ["dim", "qb", "rb"]
    tiles = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInPandas(_tile(k), "query_row long, row long, low double, high double")
    tiles = materialize(tiles, "tiles")
    best = Window.partitionBy("query_row").orderBy(F.desc("low"))
    floor = tiles.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).groupBy("query_row").agg(F.min("low").alias("floor"), F.count("*").alias("held"))
    pairs = tiles.join(floor, "query_row").filter((F.col("held") < k) | (F.col("high") >= F.col("floor"))).select("query_row", "row")
    q = rows.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("vector").alias("q"))
    x = rows.select("row", "vec_id", F.col("vector").alias("x"), "dim")
    both = pairs.join(x, "row").join(q, "query_row").repartition("query_row")
    return both.select("query_row", "query_id", "vec_id", "dim", "q", "x").mapInArrow(_heaps(k), "query_id long, rank int, vec_id long, score double")
