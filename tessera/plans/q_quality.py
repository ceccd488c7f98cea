"""Label-driven quality queries (C8-C10, C13-C16) over ``embeddings`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.numeric import round6
from tessera.operators import quality as Q
from tessera.plans.catalog import (
    EMB_LONG_SQL,
    NOISE_SOURCE_LABEL,
    embedding_vectors,
    embedding_vectors_with_noise,
)
from tessera.plans.registry import register
from tessera.sources.tables import table

D_EMB = 64


@register(
    "cluster_centroids",
    f"WITH e AS ({EMB_LONG_SQL}) SELECT cluster, CAST(j AS INTEGER) AS j, ROUND(AVG(v), 6) + 0.0 AS mean "
    "FROM e GROUP BY cluster, j",
)
def cluster_centroids(spark, sf_dir):
    c = Q.centroids_long(embedding_vectors(spark, sf_dir))
    return c.select("cluster", "j", round6("mean").alias("mean"))


@register(
    "cluster_sizes",
    "SELECT label AS cluster, COUNT(*) AS size FROM embeddings GROUP BY label",
)
def cluster_sizes(spark, sf_dir):
    return Q.cluster_sizes(embedding_vectors(spark, sf_dir))


_CENT = f"WITH e AS ({EMB_LONG_SQL}), c AS (SELECT cluster, j, AVG(v) AS m, COUNT(*) AS nk FROM e GROUP BY cluster, j)"


@register(
    "cluster_inertia",
    _CENT + " SELECT ROUND(SUM((e.v - c.m) * (e.v - c.m)), 6) + 0.0 AS inertia FROM e JOIN c USING (cluster, j)",
)
def cluster_inertia(spark, sf_dir):
    return Q.inertia_frame(embedding_vectors(spark, sf_dir), D_EMB).select(round6("inertia").alias("inertia"))


@register(
    "cluster_cohesion",
    _CENT + ", w AS (SELECT SUM((e.v - c.m) * (e.v - c.m)) AS w FROM e JOIN c USING (cluster, j)) "
    "SELECT ROUND(w / (SELECT COUNT(*) FROM embeddings), 6) + 0.0 AS cohesion FROM w",
)
def cluster_cohesion(spark, sf_dir):
    return Q.cohesion_frame(embedding_vectors(spark, sf_dir), D_EMB).select(round6("cohesion").alias("cohesion"))


@register(
    "cluster_ch_index",
    _CENT + ", g AS (SELECT j, AVG(v) AS g FROM e GROUP BY j), "
    "w AS (SELECT SUM((e.v - c.m) * (e.v - c.m)) AS w FROM e JOIN c USING (cluster, j)), "
    "b AS (SELECT SUM(c.nk * (c.m - g.g) * (c.m - g.g)) AS b FROM c JOIN g USING (j)), "
    "kn AS (SELECT COUNT(DISTINCT cluster) AS k, COUNT(DISTINCT row_id) AS n FROM e) "
    "SELECT ROUND(CASE WHEN w = 0 THEN 1.0 ELSE (b / (k - 1)) / (w / (n - k)) END, 6) + 0.0 AS ch_index "
    "FROM w, b, kn",
)
def cluster_ch_index(spark, sf_dir):
    return Q.ch_frame(embedding_vectors(spark, sf_dir), D_EMB).select(round6("ch_index").alias("ch_index"))


SILHOUETTE_SQL = (
    "WITH e AS (SELECT vec_id AS row_id, label AS cluster, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), "
    "pd AS (SELECT a.row_id, a.cluster AS own, b.cluster AS other, AVG(list_distance(a.x, b.x)) AS md "
    "       FROM e a JOIN e b ON a.row_id <> b.row_id GROUP BY 1, 2, 3), "
    "ab AS (SELECT row_id, own, MAX(CASE WHEN other = own THEN md END) AS a, "
    "       MIN(CASE WHEN other <> own THEN md END) AS b FROM pd GROUP BY 1, 2), "
    "s AS (SELECT e.row_id, CASE WHEN ab.a IS NULL OR ab.b IS NULL THEN 0.0 "
    "      WHEN GREATEST(ab.a, ab.b) = 0 THEN 0.0 ELSE (ab.b - ab.a) / GREATEST(ab.a, ab.b) END AS s "
    "      FROM e LEFT JOIN ab ON ab.row_id = e.row_id) "
    "SELECT ROUND(AVG(s), 6) + 0.0 AS silhouette FROM s"
)


@register("cluster_silhouette", SILHOUETTE_SQL)
def cluster_silhouette(spark, sf_dir):
    rows = Q.silhouette_rows(embedding_vectors(spark, sf_dir))
    return rows.agg(round6(F.avg("s")).alias("silhouette"))


@register(
    "noise_rate",
    f"WITH l AS (SELECT CASE WHEN label = {NOISE_SOURCE_LABEL} THEN -1 ELSE label END AS cluster FROM embeddings) "
    "SELECT ROUND(AVG(CASE WHEN cluster < 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS noise_rate, "
    "CAST(COALESCE(MAX(CASE WHEN cluster >= 0 THEN cluster END) + 1, 0) AS INTEGER) AS n_clusters FROM l",
)
def noise_rate(spark, sf_dir):
    s = Q.noise_stats(embedding_vectors_with_noise(spark, sf_dir))
    return s.select(round6("noise_rate").alias("noise_rate"), "n_clusters")


ARI_SQL = (
    "WITH cont AS (SELECT l_returnflag AS a, l_linestatus AS b, CAST(COUNT(*) AS DOUBLE) AS nij FROM lineitem GROUP BY 1, 2), "
    "t AS (SELECT SUM(nij * (nij - 1) / 2) AS sij, SUM(nij) AS n FROM cont), "
    "ai AS (SELECT SUM(ni * (ni - 1) / 2) AS sa FROM (SELECT SUM(nij) AS ni FROM cont GROUP BY a)), "
    "bj AS (SELECT SUM(nj * (nj - 1) / 2) AS sb FROM (SELECT SUM(nij) AS nj FROM cont GROUP BY b)), "
    "x AS (SELECT sij, sa * sb / (n * (n - 1) / 2) AS ex, (sa + sb) / 2 AS mx FROM t, ai, bj) "
    "SELECT ROUND(CASE WHEN mx - ex = 0 THEN 1.0 ELSE (sij - ex) / (mx - ex) END, 6) + 0.0 AS ari FROM x"
)


@register("stability_ari", ARI_SQL)
def stability_ari(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"))
    return Q.adjusted_rand_index(li).select(round6("ari").alias("ari"))
