"""Diagnostics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.numeric import round6
from tessera.operators import diagnostics as D
from tessera.operators import interpret as I
from tessera.operators import postprocess as L
from tessera.operators.metric_index import build_index, indexed_knn
from tessera.plans.catalog import embedding_vectors
from tessera.plans.q_post import FEATS, _ZL, labeled_matrix
from tessera.plans.q_select import GMM_SQL, _bic_icl_curves
from tessera.plans.registry import register

KNN_M = 15


def _vecs(pm_matrix):
    return pm_matrix.select("row_id", "l_orderkey", "l_linenumber", F.array(*[F.col(c) for c in FEATS]).alias("x"))


@register(
    "pca_covariance",
    _ZL + " " + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, ROUND(COVAR_SAMP({a}, {b}), 6) + 0.0 AS cov FROM zl"
        for i, a in enumerate(FEATS) for j, b in enumerate(FEATS) if i <= j
    ),
)
def pca_covariance(spark, sf_dir):
    pm, _ = labeled_matrix(spark, sf_dir)
    _, cov, _ = D.covariance(_vecs(pm.matrix), len(FEATS))
    rows = [(a, b, float(cov[i, j])) for i, a in enumerate(FEATS) for j, b in enumerate(FEATS) if i <= j]
    return spark.createDataFrame(rows, "feature_a string, feature_b string, cov double").select(
        "feature_a", "feature_b", round6("cov").alias("cov")
    )


@register("pca_coords")
def pca_coords(spark, sf_dir):
    pm, _ = labeled_matrix(spark, sf_dir)
    v = _vecs(pm.matrix)
    pca, _ = D.fit_pca(v, len(FEATS))
    return D.pca_coords(v, pca, keep=("l_orderkey", "l_linenumber"))


@register("pca_variance_ratio")
def pca_variance_ratio(spark, sf_dir):
    pm, _ = labeled_matrix(spark, sf_dir)
    pca, _ = D.fit_pca(_vecs(pm.matrix), len(FEATS))
    rows = [(i + 1, float(r)) for i, r in enumerate(pca.explained_variance_ratio)]
    return spark.createDataFrame(rows, "component int, ratio double")


@register(
    "knn_edges",
    "WITH e AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), "
    "p AS (SELECT a.row_id, b.row_id AS nbr_id, list_distance(a.x, b.x) AS dist FROM e a JOIN e b ON TRUE), "
    "r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY row_id ORDER BY dist, nbr_id) AS rank FROM p) "
    f"SELECT row_id, nbr_id, ROUND(dist, 6) + 0.0 AS dist, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {KNN_M}",
)
def knn_edges(spark, sf_dir):
    v = embedding_vectors(spark, sf_dir)
    n = v.count()
    return indexed_knn(build_index(v, n), KNN_M).select("row_id", "nbr_id", round6("dist").alias("dist"), F.col("rank").cast("int"))


@register("spectral_layout")
def spectral_layout(spark, sf_dir):
    v = embedding_vectors(spark, sf_dir)
    return D.spectral_layout(v, v.count())


@register(
    "spectral_orthonormal",
    "SELECT i AS a, j AS b, CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS dot, COUNT(*) AS n_rows "
    "FROM embeddings, (VALUES (1, 1), (1, 2), (2, 2)) t(i, j) GROUP BY i, j",
)
def spectral_orthonormal(spark, sf_dir):
    """Dot products of the layout's columns over all rows: orthonormal, whatever the data are."""
    y = spectral_layout(spark, sf_dir)
    pairs = [F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), (F.col(f"dim{i}") * F.col(f"dim{j}")).alias("d")) for i, j in ((1, 1), (1, 2), (2, 2))]
    terms = y.select(F.explode(F.array(*pairs)).alias("t")).groupBy("t.a", "t.b")
    return terms.agg(F.round(F.sum("t.d"), 6).alias("dot"), F.count(F.lit(1)).alias("n_rows")).select("a", "b", (F.col("dot") + 0.0).alias("dot"), "n_rows")


HEAT_SQL = (
    _ZL + ", cm AS (SELECT cluster, " + ", ".join(f"AVG({c}) AS {c}" for c in FEATS) + " FROM zl GROUP BY cluster) "
    + " UNION ALL ".join(f"SELECT cluster, '{c}' AS feature, ROUND({c}, 6) + 0.0 AS z FROM cm" for c in FEATS)
)


@register("zprofile_heatmap", HEAT_SQL)
def zprofile_heatmap(spark, sf_dir):
    pm, zl = labeled_matrix(spark, sf_dir)
    final_ids = sorted(L.sizes_of(zl))
    h = D.heatmap(I.cluster_means(zl, FEATS), FEATS, final_ids)
    return h.select("cluster", "feature", round6("z").alias("z"))


@register(
    "chart_frame",
    _ZL + f" SELECT l_orderkey, l_linenumber, ROUND({FEATS[0]}, 6) + 0.0 AS dim1, ROUND({FEATS[1]}, 6) + 0.0 AS dim2, cluster, "
    "'Cluster ' || CAST(cluster AS VARCHAR) AS label FROM zl",
)
def chart_frame(spark, sf_dir):
    """Projection = the first two scaled features; hover = the line identity."""
    pm, zl = labeled_matrix(spark, sf_dir)
    proj = zl.select("row_id", round6(FEATS[0]).alias("dim1"), round6(FEATS[1]).alias("dim2"))
    out = D.chart_frame(proj, zl, ("l_orderkey", "l_linenumber"))
    return out.select("l_orderkey", "l_linenumber", "dim1", "dim2", "cluster", "label")


@register(
    "size_frame",
    _ZL + " SELECT cluster, 'Cluster ' || CAST(cluster AS VARCHAR) AS label, COUNT(*) AS size FROM zl GROUP BY cluster",
)
def size_frame(spark, sf_dir):
    _, zl = labeled_matrix(spark, sf_dir)
    return D.size_frame(zl).select("cluster", "label", "size")


@register(
    "curve_frame",
    GMM_SQL + "SELECT 'bic' AS metric, CAST(k AS INTEGER) AS k, ROUND(bic, 6) + 0.0 AS value FROM cv",
)
def curve_frame(spark, sf_dir):
    rows = [("bic", k, b) for k, b, _ in _bic_icl_curves(spark, sf_dir)]
    return spark.createDataFrame(rows, "metric string, k int, value double").select("metric", "k", round6("value").alias("value"))

