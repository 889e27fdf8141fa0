"""Queries of feature-space models over the embeddings and scored labels."""

from pyspark.sql import functions as F

from ..functions.columns import log_odds
from ..operators import density, learn
from .registry import query


def _x(v):
    return v.embeddings.select("vec_id", F.col("embedding").alias("x"), "label")


@query("model02_robust_scaler", "", """WITH l AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT i, median(v) AS m FROM l GROUP BY i),
s AS (SELECT l.i, any_value(m) AS m, 1.4826 * median(abs(v - m)) AS mad FROM l JOIN m ON l.i = m.i GROUP BY l.i)
SELECT vec_id, sum(least(greatest((v - m) / mad, -8), 8)) AS total FROM l JOIN s ON l.i = s.i GROUP BY vec_id""", "total")  # fmt: skip
def _(v):
    return learn.robust_scaler(_x(v), "vec_id").select("vec_id", F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("model03_pca")
def _(v):
    rows, _ = learn.principal_components(_x(v), 4)
    return rows.select("vec_id", "components")


@query("model04_autoencoder_score")
def _(v):
    return learn.reconstruction_score(_x(v), 8).select("vec_id", "error", "score")


@query("model05_kmeans")
def _(v):
    return learn.kmeans(_x(v), 5).groupBy("cluster").agg(F.count("*").alias("n"))


@query("model06_dbscan")
def _(v):
    return learn.dbscan(_x(v), "vec_id", 0.9, 4)


_NEAR = "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), d AS (SELECT a.vec_id, b.vec_id AS other, b.label = a.label AS same, list_distance(a.e, b.e) AS dist FROM v a JOIN v b ON a.vec_id <> b.vec_id), n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(dist, 9), other) AS rank FROM d)"


@query("win10_neighbours", "", _NEAR + " SELECT vec_id, other, CAST(rank AS INTEGER) AS rank, dist FROM n WHERE rank <= 5", "dist")
def _(v):
    return learn.neighbours(_x(v), "vec_id", 5)


@query("win11_novelty", "", _NEAR + " SELECT vec_id, avg(dist) AS novelty FROM n WHERE rank <= 8 GROUP BY vec_id", "novelty")
def _(v):
    return learn.novelty(learn.neighbours(_x(v), "vec_id", 8), "vec_id")


@query("agg57_retrieval_purity", "", _NEAR + " SELECT avg(CASE WHEN same THEN 1.0 ELSE 0 END) AS purity, (SELECT sum(c * c) / pow(sum(c), 2) FROM (SELECT count(*) AS c FROM embeddings GROUP BY label)) AS chance FROM n WHERE rank <= 3", "purity chance")
def _(v):
    return learn.retrieval_purity(learn.neighbours(_x(v), "vec_id", 3), _x(v).select("vec_id", "label"), "vec_id")


@query("win20_isotonic")
def _(v):
    return learn.isotonic(v.scored_labels.select("doc_id", "score", "y")).select("doc_id", "calibrated")


@query("model11_platt")
def _(v):
    a, b = learn.platt(v.scored_labels)
    return v.scored_labels.select("doc_id", (1 / (1 + F.exp(-(a * log_odds(F.col("score")) + b)))).alias("calibrated"))


@query("model07_hdbscan")
def _(v):
    return density.hdbscan(_x(v), "vec_id")


@query("agg56_silhouette", "", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), s AS (SELECT label, count(*) AS n FROM v GROUP BY label),
m AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.e, b.e)) / (any_value(n) - CASE WHEN a.label = b.label THEN 1 ELSE 0 END) AS mean FROM v a JOIN v b ON true JOIN s ON s.label = b.label WHERE a.label <> b.label OR n > 1 GROUP BY a.vec_id, a.label, b.label),
p AS (SELECT vec_id, max(mean) FILTER (label = other) AS a, min(mean) FILTER (label <> other) AS b FROM m GROUP BY vec_id)
SELECT avg((b - a) / greatest(a, b, 1e-12)) AS silhouette, count(*) AS n FROM p WHERE a IS NOT NULL AND b IS NOT NULL""", "silhouette")  # fmt: skip
def _(v):
    return density.silhouette(_x(v), "vec_id", "label")
