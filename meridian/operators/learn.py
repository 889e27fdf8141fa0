"""Feature-space models as Spark jobs: scaling, projections, clustering, novelty and calibration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import euclidean
from .tiles import BLOCK, close, nearest, tiles


def nearest_centroid(train: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Predicted label and its probability, falling with 1 + distance to the class means; one row per class is broadcast."""
    long = train.select("label", F.posexplode("x").alias("i", "value"))
    centres = long.groupBy("label", "i").agg(F.avg("value").alias("m")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"))
    centres = centres.select(F.col("label").alias("predicted"), F.transform("c", lambda e: e["m"]).alias("centre"))
    near = rows.select(key, "x").join(F.broadcast(centres)).withColumn("dist", euclidean(F.col("x"), F.col("centre")))
    share = 1 / (1 + F.col("dist"))
    near = near.withColumn("probability", share / F.sum(share).over(Window.partitionBy(key)))
    best = Window.partitionBy(key).orderBy(F.round("dist", 9), "predicted")
    return near.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r", "x", "centre")


def robust_scaler(rows: DataFrame, key: str, clip_at: float = 8.0) -> DataFrame:
    """Array ``x`` scaled per dimension: median imputed, over 1.4826 MAD (deviation where that is 0), clipped."""
    long = rows.select(key, F.posexplode("x").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    middle = long.groupBy("i").agg(F.median("v").alias("m"), F.stddev_pop("v").alias("sd"))
    spread = long.join(middle, "i").groupBy("i").agg(F.first("m").alias("m"), F.first("sd").alias("sd"), (1.4826 * F.median(F.abs(F.col("v") - F.col("m")))).alias("mad"))
    width = F.when(F.col("mad") > 1e-12, F.col("mad")).when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0)
    # one row per dimension: a fixed, small size
    fit = spread.agg(F.array_sort(F.collect_list(F.struct("i", "m", width.alias("w")))).alias("fit"))
    bound = F.lit(float(clip_at))
    scaled = F.zip_with("x", "fit", lambda v, f: F.least(F.greatest((F.coalesce(v.cast("double"), f["m"]) - f["m"]) / f["w"], -bound), bound))
    return rows.join(F.broadcast(fit)).withColumn("scaled", scaled).drop("fit")


def _vectors(rows: DataFrame, column: str = "x") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


def principal_components(rows: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """Rows with ``components`` and the variance shares."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    data = _vectors(rows)
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(data)
    return model.transform(data).withColumn("components", vector_to_array("pc")).drop("features", "pc"), model.explainedVariance.toArray().tolist()


def reconstruction_score(rows: DataFrame, k: int) -> DataFrame:
    """Root-mean-square error of a linear autoencoder over its median: distance left outside the first k components."""
    mean = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"))
    mean = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("mean"))
    centred = rows.join(F.broadcast(mean)).withColumn("x", F.zip_with("x", "mean", lambda a, b: a.cast("double") - b)).drop("mean")
    scored, _ = principal_components(centred, k)

    def square(c):
        return F.aggregate(F.transform(c, lambda v: v * v), F.lit(0.0), lambda s, v: s + v)

    error = F.sqrt(F.greatest(square("x") - square("components"), F.lit(0.0)) / F.size("x"))
    scored = scored.withColumn("error", error).drop("components")
    return scored.join(F.broadcast(scored.agg(F.median("error").alias("median_error")))).withColumn("score", F.col("error") / F.col("median_error"))


def kmeans(rows: DataFrame, k: int, seeds: int = 4) -> DataFrame:
    """Rows with ``cluster``: best of several k-means|| starts by training cost."""
    from pyspark.ml.clustering import KMeans

    data = _vectors(rows)
    models = [KMeans(k=k, seed=s, maxIter=30).fit(data) for s in range(seeds)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(data).withColumnRenamed("prediction", "cluster").drop("features")


def _finite(rows: DataFrame, key: str) -> DataFrame:
    """(id, x) of the rows whose vectors hold finite numbers only."""
    return rows.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))).select(F.col(key).alias("id"), "x")


def neighbours(rows: DataFrame, key: str, k: int, block: int = BLOCK) -> DataFrame:
    """(key, other, rank, dist): k nearest by Euclidean distance, equal to nine decimals in order of id. Each tile keeps k per row."""

    def tile(a, x, b, y):
        return nearest(a["id"].to_numpy(), x, b["id"].to_numpy(), y, k, digits=9)

    some = _finite(rows, key)
    order = Window.partitionBy("id").orderBy(F.round("dist", 9), "other")
    found = tiles(some, some, tile, "id long, other long, dist double", block)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(F.col("id").alias(key), "other", "rank", "dist")


def novelty(near: DataFrame, key: str) -> DataFrame:
    return near.groupBy(key).agg(F.avg("dist").alias("novelty"))


def retrieval_purity(near: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Mean share of neighbours with the row's own label, against the chance sum of squared shares."""
    own, other = labels.select(key, F.col("label").alias("mine")), labels.select(F.col(key).alias("other"), F.col("label").alias("theirs"))
    hit = near.join(own, key).join(other, "other").agg(F.avg((F.col("mine") == F.col("theirs")).cast("double")).alias("purity"))
    share = labels.groupBy("label").count().agg((F.sum(F.col("count") * F.col("count")) / (F.sum("count") * F.sum("count"))).alias("chance"))
    return hit.join(share)


def dbscan(rows: DataFrame, key: str, eps: float, min_samples: int, block: int = BLOCK) -> DataFrame:
    """Cluster per row, -1 for noise. No pair leaves a tile: rows' counts do, then core rows' links as a forest of each tile, then
    the smallest cluster that each other row reaches."""
    from .rounds import components, cut

    data = cut(_finite(rows, key))

    def counts(a, x, b, y):
        return pd.DataFrame({"id": a["id"].to_numpy(), "n": np.concatenate([near.sum(axis=1) for _, near in close(x, y, eps)])})

    # a row is within eps of itself
    core = cut(tiles(data, data, counts, "id long, n long", block).groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_samples).select("id"))

    def forest(a, x, b, y):
        ids, others, label, out = a["id"].to_numpy(), b["id"].to_numpy(), np.arange(len(b)), []
        for at, near in close(x, y, eps):
            for r, hit in enumerate(near):
                j = np.flatnonzero(hit)
                if not len(j):
                    continue
                if (label[j] == label[j[0]]).all():
                    out.append((ids[at.start + r], others[j[0]]))
                    continue
                names, first = np.unique(label[j], return_index=True)
                out += [(ids[at.start + r], o) for o in others[j[first]]]
                to = np.arange(len(b))
                to[names] = names[0]
                label = to[label]
        return pd.DataFrame(out, columns=["a", "b"])

    dense = cut(data.join(core, "id", "left_semi"))
    cluster = cut(components(tiles(dense, dense, forest, "a long, b long", block), core))

    def reached(a, x, b, y):
        names, most = b["component"].to_numpy(), np.iinfo(np.int64).max
        least = np.concatenate([np.where(near, names, most).min(axis=1) for _, near in close(x, y, eps)])
        return pd.DataFrame({"id": a["id"].to_numpy()[least < most], "reached": least[least < most]})

    border = tiles(data.join(core, "id", "left_anti"), dense.join(cluster, "id"), reached, "id long, reached long", block).groupBy("id").agg(F.min("reached").alias("reached"))
    out = rows.select(F.col(key).alias("id")).join(cluster, "id", "left").join(border, "id", "left")
    return out.select(F.col("id").alias(key), F.coalesce("component", "reached", F.lit(-1)).alias("cluster"))


def isotonic(rows: DataFrame) -> DataFrame:
    """Calibrated (score -> probability) step function, applied to the rows (score, y)."""
    from pyspark.ml.regression import IsotonicRegression

    model = IsotonicRegression(labelCol="y", featuresCol="score").fit(rows.withColumn("y", F.col("y").cast("double")))
    return model.transform(rows.withColumn("y", F.col("y").cast("double"))).withColumn("calibrated", F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0))).drop("prediction")


def platt(rows: DataFrame, rounds: int = 30) -> tuple[float, float]:
    """Slope and offset of a logistic map on log-odds: Newton steps on smoothed targets, each one aggregation."""
    import math

    from ..functions.columns import log_odds

    n1, n0 = rows.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    hi, lo = (n1 + 1) / (n1 + 2), 1 / (n0 + 2)
    data = rows.select(log_odds(F.col("score")).alias("f"), F.when(F.col("y") == 1, hi).otherwise(lo).alias("t"))
    a, b = 0.0, math.log((n1 + 1) / (n0 + 1))
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(a * F.col("f") + b)))
        w, d = p * (1 - p), p - F.col("t")
        g1, g2, h11, h12, h22 = data.agg(F.sum(d * F.col("f")), F.sum(d), F.sum(w * F.col("f") ** 2), F.sum(w * F.col("f")), F.sum(w)).first()
        det = (h11 + 1e-9) * (h22 + 1e-9) - h12 * h12
        da, db = ((h22 + 1e-9) * g1 - h12 * g2) / det, ((h11 + 1e-9) * g2 - h12 * g1) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def mahalanobis(rows: DataFrame, key: str, columns: list[str], ridge: float = 1e-6) -> DataFrame:
    """Distance from the medians under the inverse covariance; the few moments come from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    got = rows.agg(*[F.median(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_samp(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first()
    k = len(columns)
    cov = np.zeros((k, k))
    for (a, b), value in zip(pairs, got[k:], strict=True):
        cov[columns.index(a), columns.index(b)] = cov[columns.index(b), columns.index(a)] = value or 0.0
    inverse = np.linalg.pinv(cov + ridge * np.eye(k))
    away = [F.col(c) - float(m or 0.0) for c, m in zip(columns, got[:k], strict=True)]
    square = sum((float(inverse[i, j]) * away[i] * away[j] for i in range(k) for j in range(k)), F.lit(0.0))
    return rows.select(key, F.sqrt(F.greatest(square, F.lit(0.0))).alias("distance"))


def isolation_forest(rows: DataFrame, key: str, trees: int = 128, sample: int = 256, seed: int = 0) -> DataFrame:
    """Anomaly score 2^(-mean depth / c(n)). Trees grow apart on hashed samples of about ``sample`` rows; the forest, of bounded size, is broadcast."""
    n = max(1, rows.count())
    share = min(1.0, sample / n)
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(F.col(key), t, F.lit(seed)), F.lit(1_000_000)) < share * 1_000_000)
    picked = rows.select("x", F.col(key).alias("id"), F.explode(drawn).alias("tree"))

    def path(n: float) -> float:
        return 0.0 if n <= 1 else 2 * (np.log(max(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        x, out = np.stack(part["x"].to_numpy()).astype(float), []
        rng, limit = np.random.default_rng(seed + int(part["tree"].iat[0])), int(np.ceil(np.log2(max(2, len(x)))))
        stack, made = [(0, np.arange(len(x)), 0)], 1
        while stack:
            node, at, depth = stack.pop()
            spread = np.ptp(x[at], axis=0)
            if depth >= limit or len(at) <= 1 or not spread.any():
                out.append((node, -1, depth + path(len(at)), -1, -1))
                continue
            dim = rng.choice(np.flatnonzero(spread))
            cut_at = rng.uniform(x[at, dim].min(), x[at, dim].max())
            low = x[at, dim] < cut_at
            out.append((node, int(dim), float(cut_at), made, made + 1))
            stack += [(made, at[low], depth + 1), (made + 1, at[~low], depth + 1)]
            made += 2
        return pd.DataFrame(out, columns=["node", "dim", "value", "left", "right"]).assign(tree=part["tree"].iat[0])

    forest = picked.groupBy("tree").applyInPandas(grow, "node int, dim int, value double, left int, right int, tree int").toPandas()
    built = [t.sort_values("node").to_numpy()[:, 1:5] for _, t in forest.groupby("tree")]
    shared = rows.sparkSession.sparkContext.broadcast((built, path(min(sample, n))))

    @F.pandas_udf("double")
    def score(xs: pd.Series) -> pd.Series:
        forest, usual = shared.value
        x, total = np.stack(xs.to_numpy()).astype(float), np.zeros(len(xs))
        for t in forest:
            at = np.zeros(len(x), int)
            while True:
                inner = t[at, 0] >= 0
                if not inner.any():
                    break
                go = np.flatnonzero(inner)
                here = t[at[go]]
                at[go] = np.where(x[go, here[:, 0].astype(int)] < here[:, 1], here[:, 2], here[:, 3]).astype(int)
            total += t[at, 1]
        return pd.Series(2 ** (-total / max(1, len(forest)) / max(usual, 1e-9)))

    return rows.select(key, score("x").alias("score"))


def ensemble(scores: list[DataFrame], key: str) -> DataFrame:
    """Mean over detectors of the logistic of each score's robust z; ``scores`` are (key, score) tables."""
    from functools import reduce

    parts = []
    for i, s in enumerate(scores):
        middle = s.agg(F.median("score").alias("m"))
        s = s.join(F.broadcast(middle)).withColumn("away", F.abs(F.col("score") - F.col("m")))
        spread = s.agg((1.4826 * F.median("away")).alias("w"))
        z = (F.col("score") - F.col("m")) / F.greatest("w", F.lit(1e-9))
        parts.append(s.join(F.broadcast(spread)).select(key, (1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-60.0)), F.lit(60.0))))).alias(f"s{i}")))
    rows = reduce(lambda a, b: a.join(b, key), parts)
    total = reduce(lambda a, b: a + b, [F.col(f"s{i}") for i in range(len(parts))])
    return rows.withColumn("score", total / len(parts))


def score_rows(rows: DataFrame, key: str, features: list[str], predict, classes: list[str]) -> DataFrame:
    """(key, one probability per class) from ``predict``, a function of a numpy matrix, called batch by batch."""

    def run(batches):
        for b in batches:
            p = predict(b[features].to_numpy(float))
            yield pd.DataFrame({key: b[key], **{c: p[:, i] for i, c in enumerate(classes)}})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *features).mapInPandas(run, f"{key} {kind}, " + ", ".join(f"{c} double" for c in classes))


def linear_probe(train: DataFrame, test: DataFrame, penalty: float = 1e-3) -> DataFrame:
    """(label, n, recall, accuracy, balanced): a multinomial linear model on vectors ``x``, one row per label of the test rows."""
    from pyspark.ml.classification import LogisticRegression

    model = LogisticRegression(family="multinomial", regParam=penalty, maxIter=100).fit(_vectors(train))
    hit = (F.col("prediction") == F.col("label")).cast("double")
    per = model.transform(_vectors(test)).groupBy("label").agg(F.count("*").alias("n"), F.avg(hit).alias("recall"))
    whole = per.agg((F.sum(F.col("n") * F.col("recall")) / F.sum("n")).alias("accuracy"), F.avg("recall").alias("balanced"))
    return per.join(F.broadcast(whole))
