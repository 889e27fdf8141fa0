"""Density clustering without a radius: spanning trees of mutual reachability; silhouettes. Vectors meet in tiles of blocks.

Distances that decide anything are square roots of summed squared differences (``tiles.exact``), so equal vectors are at distance 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .match import number_rows
from .quantiles import quantiles
from .rounds import components, cut
from .tiles import BLOCK, distances, exact, nearest, squares, tiles, unit_of

def vectors(rows: DataFrame, key: str, *extra: str) -> DataFrame:
    """id, x (floats as they are, else doubles; missing and not finite numbers are 0) and some columns of rows with an array ``x``."""
    kind = "float" if rows.schema["x"].dataType.simpleString() == "array<float>" else "double"
    number = F.transform(F.col("x").cast(f"array<{kind}>"), lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0).cast(kind)).otherwise(v))
    return rows.select(F.col(key).cast("long").alias("id"), number.alias("x"), *extra)


def nearest_lists(rows: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(id, other, rank, dist): the k nearest others of every row of (id, x); equal distances in order of id."""

    def tile(a, x, b, y):
        return nearest(a["id"].to_numpy(), x, b["id"].to_numpy(), y, k)

    found = tiles(rows, rows, tile, "id long, other long, dist double", block)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("dist", "other"))).filter(F.col("rank") <= k)


def _cheapest_outgoing(some: DataFrame, rows: DataFrame, block: int) -> DataFrame:
    """comp, edge: each component's cheapest reachability edge from the rows of ``some`` (id, x, core, comp) to another component."""

    def tile(a, x, b, y):
        ids, core, comp = (a[c].to_numpy() for c in ("id", "core", "comp"))
        others, core2, comp2 = (b[c].to_numpy() for c in ("id", "core", "comp"))
        order = np.argsort(comp2, kind="stable")
        others, core2, comp2, y = others[order], core2[order], comp2[order], y[order]
        own = np.stack([np.searchsorted(comp2, comp, "left"), np.searchsorted(comp2, comp, "right")], axis=1)
        names, which = np.unique(comp, return_inverse=True)
        unit, top, out = unit_of(x, y), np.full(len(names), np.inf), []
        least, least2 = (core / unit) ** 2, (core2 / unit) ** 2

        def first(edges: pd.DataFrame) -> pd.DataFrame:  # equal weights: the smaller ends
            return edges.sort_values(["comp", "w", "lo", "hi"]).drop_duplicates("comp")

        for rows, found, error in squares(x, y, unit):
            np.maximum(found, least2, out=found)
            for r, (start, stop) in enumerate(own[rows]):
                found[r, start:stop] = np.inf
            low = np.maximum(found.min(axis=1), least[rows])
            error = error + 1e-12 * np.where(np.isfinite(low), low, 0)
            some = np.flatnonzero(np.isfinite(low) & (low - error <= (top[which[rows]] / unit) ** 2))
            i, j = np.nonzero(found[some] <= (low + 2 * error)[some, None])
            if not len(i):
                continue
            i = some[i] + rows.start
            w = np.maximum(np.maximum(exact(x, y, i, j), core[i]), core2[j])
            out.append(first(pd.DataFrame({"comp": comp[i], "w": w, "lo": np.minimum(ids[i], others[j]), "hi": np.maximum(ids[i], others[j]), "to": comp2[j]})))
            np.minimum.at(top, which[i], w)
        return first(pd.concat(out)) if out else pd.DataFrame({c: [] for c in ("comp", "w", "lo", "hi", "to")})

    found = tiles(some, rows, tile, "comp long, w double, lo long, hi long, to long", block)
    return found.groupBy("comp").agg(F.min(F.struct("w", "lo", "hi", "to")).alias("edge"))


def spanning_tree(rows: DataFrame, min_samples: int, lists: int = 0, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Minimum spanning tree (a, b, w) of mutual reachability over (id, x), and (id, core).

    Reachability is the largest of the distance and both rows' distances to their ``min_samples``-th neighbour. Boruvka
    rounds: each component takes its cheapest edge out. Lists of near neighbours offer edges first; an edge that no list
    rules out costs at least the row's last listed distance, so a component whose best listed edge costs more than
    that searches all rows from those rows that might do better. Nothing is left out, whatever the lists' length.
    """
    n = rows.count()
    k = min(min_samples, n - 1)
    lists = min(max(lists, 2 * min_samples), n - 1)
    near = cut(nearest_lists(rows, lists, block))
    core = cut(near.groupBy("id").agg(F.max(F.when(F.col("rank") == k, F.col("dist"))).alias("core"), F.max("dist").alias("reach")))
    ends = core.select("id", "core")
    edges = near.join(ends, "id").join(ends.select(F.col("id").alias("other"), F.col("core").alias("core2")), "other")
    edges = edges.select(F.col("id").alias("a"), F.col("other").alias("b"), F.greatest("dist", "core", "core2").alias("w"))
    edges = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).distinct())
    state = cut(rows.join(core, "id").withColumn("comp", F.col("id")))
    tree = None
    while True:
        comp = state.select("id", "comp")
        edges = edges.select("a", "b", "w").join(comp.select(F.col("id").alias("a"), F.col("comp").alias("from")), "a").join(comp.select(F.col("id").alias("b"), F.col("comp").alias("to")), "b")
        edges = cut(edges.filter(F.col("from") != F.col("to")))
        listed = edges.groupBy(F.col("from").alias("comp")).agg(F.min(F.struct("w", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "to")).alias("edge"))
        listed = cut(listed)
        bound = F.lit(float("inf")) if lists == n - 1 else F.greatest("reach", "core")
        open_rows = state.join(listed, "comp", "left").filter(F.col("edge").isNull() | (bound < F.col("edge.w")))
        exact = cut(_cheapest_outgoing(open_rows.select("id", "x", "core", "comp"), state.select("id", "x", "core", "comp"), block))
        best = cut(listed.unionByName(exact).groupBy("comp").agg(F.min("edge").alias("edge")))
        if best.isEmpty():
            break
        chosen = best.select(F.col("edge.lo").alias("a"), F.col("edge.hi").alias("b"), F.col("edge.w").alias("w")).distinct()
        tree = cut(chosen if tree is None else tree.unionByName(chosen))
        merged = components(best.select(F.col("comp").alias("a"), F.col("edge.to").alias("b"))).withColumnRenamed("id", "comp")
        state = cut(state.join(merged, "comp").drop("comp").withColumnRenamed("component", "comp"))
    if tree is None:
        tree = rows.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("w")).limit(0)
    return tree, ends


def hdbscan(rows: DataFrame, key: str, min_cluster_size: int = 5, min_samples: int | None = None, block: int = BLOCK) -> DataFrame:
    """(key, cluster, probability): clusters of the spanning tree cut at the most stable of 13 quantiles of its edges, -1 for noise.

    A cut's score is the share of rows in clusters of at least ``min_cluster_size`` rows, raised for balanced sizes and lowered
    for many clusters; equal scores take the shorter cut. Probability falls with the row's core distance within its cluster.
    """
    data = cut(vectors(rows, key))
    n = data.count()
    if n < max(2, min_cluster_size):
        return data.select(F.col("id").alias(key), F.lit(-1).cast("long").alias("cluster"), F.lit(0.0).alias("probability"))
    tree, core = spanning_tree(data, min_samples or min_cluster_size, block=block)
    cuts = quantiles(tree, "w", np.linspace(0.35, 0.95, 13).tolist())
    # all cuts at once: a row's copy for each cut is a node of its own
    at = F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(cuts)]), lambda c: c["c"] >= F.col("w")))
    edges = tree.select("a", "b", at.alias("at")).select((F.col("a") * 16 + F.col("at.i")).alias("a"), (F.col("b") * 16 + F.col("at.i")).alias("b"))
    parts = cut(components(edges).select(F.shiftright("id", 4).alias("id"), F.col("id").bitwiseAND(F.lit(15)).alias("i"), F.shiftright("component", 4).alias("component")))
    sizes = cut(parts.groupBy("i", "component").count().filter(F.col("count") >= min_cluster_size))
    balance = F.when(F.count("*") > 1, F.min("count") / F.max("count")).otherwise(1.0)
    scored = sizes.groupBy("i").agg((F.sum("count") / F.lit(n) * (0.5 + 0.5 * balance) / (1 + 0.05 * F.count("*"))).alias("score")).collect()
    if not scored:
        return data.select(F.col("id").alias(key), F.lit(-1).cast("long").alias("cluster"), F.lit(0.0).alias("probability"))
    best = max(scored, key=lambda r: (r.score, -r.i)).i
    named = number_rows(sizes.filter(F.col("i") == best).select("component"), "component").select("component", (F.col("number") - 1).cast("long").alias("cluster"))
    member = parts.filter(F.col("i") == best).join(named, "component").join(core, "id")
    worst = member.groupBy("cluster").agg(F.max("core").alias("worst"))
    member = member.join(worst, "cluster").select("id", "cluster", (1 - F.when(F.col("worst") > 0, F.col("core") / F.col("worst")).otherwise(0.0)).alias("probability"))
    out = data.select("id").join(member, "id", "left")
    return out.select(F.col("id").alias(key), F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"), F.coalesce("probability", F.lit(0.0)).alias("probability"))


def silhouettes(rows: DataFrame, key: str, label: str, block: int = BLOCK) -> DataFrame:
    """(key, label, silhouette) of every row with a label of at least 0 whose cluster has another row.

    A tile returns each row's sum of distances for each cluster of the other side; no pair leaves it.
    """
    data = cut(vectors(rows.filter(F.col(label) >= 0), key, F.col(label).alias("label")))

    def tile(a, x, b, y):
        ids, order = a["id"].to_numpy(), np.argsort(b["label"].to_numpy(), kind="stable")
        names, starts = np.unique(b["label"].to_numpy()[order], return_index=True)
        sums = np.concatenate([np.add.reduceat(d, starts, axis=1) for _, d in distances(x, y[order])])
        return pd.DataFrame({"id": np.repeat(ids, len(names)), "label": np.repeat(a["label"].to_numpy(), len(names)), "other": np.tile(names, len(ids)), "total": sums.ravel()})

    totals = tiles(data, data, tile, "id long, label int, other int, total double", block).groupBy("id", "label", "other").agg(F.sum("total").alias("total"))
    sizes = data.groupBy(F.col("label").alias("other")).agg(F.count("*").alias("n"))
    own = F.col("label") == F.col("other")
    per = totals.join(sizes, "other").groupBy("id", "label").agg(
        F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b")
    )
    score = (F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-12))
    return per.filter("a IS NOT NULL AND b IS NOT NULL").select(F.col("id").alias(key), "label", score.alias("silhouette"))


def silhouette(rows: DataFrame, key: str, label: str, block: int = BLOCK) -> DataFrame:
    """One row: the mean silhouette and the rows it is of; null below three rows or two clusters."""
    return silhouettes(rows, key, label, block).agg(F.when(F.count("*") >= 1, F.avg("silhouette")).alias("silhouette"), F.count("*").alias("n"))
