"""Density-clustering queries (C12a-c) over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.numeric import round6
from tessera.operators import density as H
from tessera.operators.metric_index import build_index, indexed_knn
from tessera.plans.catalog import embedding_vectors
from tessera.plans.registry import register
from tessera.session import cut_lineage
from tessera.sources.tables import table

MIN_SAMPLES = 5
KNN_M = 15

_P = (
    "WITH e AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), "
    "p AS (SELECT a.row_id, b.row_id AS nbr_id, list_distance(a.x, b.x) AS dist FROM e a JOIN e b ON TRUE), "
    "r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY row_id ORDER BY dist, nbr_id) AS rn FROM p), "
    f"core AS (SELECT row_id, dist AS core FROM r WHERE rn = {MIN_SAMPLES}) "
)


@register("core_distance", _P + "SELECT row_id, ROUND(core, 6) + 0.0 AS core FROM core")
def core_distance(spark, sf_dir):
    v = embedding_vectors(spark, sf_dir)
    return H.core_distances(v, v.count(), MIN_SAMPLES).select("row_id", round6("core").alias("core"))


@register(
    "mutual_reachability",
    _P + "SELECT r.row_id, r.nbr_id, ROUND(GREATEST(r.dist, ca.core, cb.core), 6) + 0.0 AS mr "
    f"FROM r JOIN core ca ON ca.row_id = r.row_id JOIN core cb ON cb.row_id = r.nbr_id WHERE r.rn <= {KNN_M}",
)
def mutual_reachability(spark, sf_dir):
    """Mutual-reachability weights of every row's kNN edges."""
    v = embedding_vectors(spark, sf_dir)
    n = v.count()
    core = H.core_distances(v, n, MIN_SAMPLES).cache()
    nb = indexed_knn(build_index(v, n), KNN_M)
    j = nb.join(core.withColumnRenamed("core", "ca"), "row_id").join(
        core.select(F.col("row_id").alias("nbr_id"), F.col("core").alias("cb")), "nbr_id"
    )
    return j.select("row_id", "nbr_id", round6(F.greatest("dist", "ca", "cb")).alias("mr"))


def _tree(vectors):
    n = vectors.count()
    mcs = max(5, n // 50)
    return H.reachability_tree(vectors, n, mcs), n, mcs


@register(
    "mst_weight",
    _P.replace("WITH e", "WITH RECURSIVE e", 1).replace(f"rn = {MIN_SAMPLES}", "rn = (SELECT GREATEST(5, COUNT(*) // 50) FROM e)").rstrip() + """,
    m AS MATERIALIZED (
      SELECT r.row_id AS a, r.nbr_id AS b, GREATEST(r.dist, ca.core, cb.core) AS w
      FROM r JOIN core ca ON ca.row_id = r.row_id JOIN core cb ON cb.row_id = r.nbr_id
    ),
    -- one row per vertex outside the tree with its distance to it; each step takes the nearest in
    prim AS (
      SELECT 1 AS step, b AS v, w AS d FROM m WHERE a = (SELECT MIN(row_id) FROM e) AND b <> a
      UNION ALL
      SELECT p.step + 1, p.v, LEAST(p.d, m.w)
      FROM prim p, (SELECT v FROM prim ORDER BY d, v LIMIT 1) x, m
      WHERE m.a = x.v AND m.b = p.v AND p.v <> x.v
    )
    SELECT COUNT(*) AS n_edges, ROUND(SUM(d), 6) + 0.0 AS total_weight
    FROM (SELECT step, MIN(d) AS d FROM prim GROUP BY step)
    """,
)
def mst_weight(spark, sf_dir):
    edges = _tree(embedding_vectors(spark, sf_dir).select("row_id", "x"))[0].edges
    return edges.agg(F.count(F.lit(1)).alias("n_edges"), round6(F.sum("w")).alias("total_weight"))


#: Letters whose shares of a text tell languages apart.
PROFILE = "aehinorstuwéèñüß"


def letter_profiles(spark, sf_dir):
    """``(row_id, x)``: per document the share of each profile letter, in percent."""
    t = F.lower(F.coalesce("text", F.lit("")))
    n = F.greatest(F.length(t), F.lit(1))
    share = [(F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))) * 100.0 / n for c in PROFILE]
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.array(*share).alias("x"))


@register("hdbscan_fit")
def hdbscan_fit(spark, sf_dir):
    """Letter profiles of all documents: a cluster per language, texts of no clear profile as noise."""
    v = cut_lineage(letter_profiles(spark, sf_dir))
    mst, n, mcs = _tree(v)
    return H.hdbscan_labels(mst, v.select("row_id"), n, mcs)
