"""Post-processing (L1-L8) and interpretation (I1-I5) queries.

Interpretation runs on the scaled lineitem matrix with the return flag as the
cluster label (dense rank of the flag, starting at 0).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.numeric import round6
from tessera.operators import interpret as I
from tessera.operators import postprocess as L
from tessera.operators import prepare as P
from tessera.plans.catalog import LINEITEM_SPEC, embedding_vectors, lineitem_features
from tessera.plans.q_prepare import ctes
from tessera.plans.q_select import GMM_SQL
from tessera.plans.registry import register
from tessera.sources.tables import table

SPEC = LINEITEM_SPEC
FEATS = SPEC.features


def labeled_matrix(spark, sf_dir):
    pm = P.prepare_matrix(lineitem_features(spark, sf_dir), SPEC)
    flags = sorted(r[0] for r in pm.matrix.select("l_returnflag").distinct().collect())
    m = F.create_map(*[x for i, f in enumerate(flags) for x in (F.lit(f), F.lit(i))])
    return pm, pm.matrix.withColumn("cluster", F.element_at(m, F.col("l_returnflag")).cast("int"))


_ZL = ctes() + ", zl AS (SELECT *, CAST(DENSE_RANK() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS cluster FROM z)"


def _corr_sql(a, b):
    return f"COVAR_POP({a}, {b}) / NULLIF(STDDEV_POP({a}) * STDDEV_POP({b}), 0)"


CORR_SQL = _ZL + " " + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, ROUND({_corr_sql(a, b)}, 6) + 0.0 AS corr FROM zl"
    for i, a in enumerate(FEATS) for j, b in enumerate(FEATS) if i < j
)


@register("feature_correlation", CORR_SQL)
def feature_correlation(spark, sf_dir):
    pm = P.prepare_matrix(lineitem_features(spark, sf_dir), SPEC)
    aggs = [
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), I.corr_expr(a, b).alias("corr"))
        for i, a in enumerate(FEATS) for j, b in enumerate(FEATS) if i < j
    ]
    rows = pm.matrix.agg(F.array(*aggs).alias("r")).select(F.explode("r").alias("s"))
    return rows.select("s.feature_a", "s.feature_b", round6("s.corr").alias("corr"))


def _phrase_sql(name: str, z: str) -> str:
    parts = []
    for f, (hi, lo) in SPEC.qualifiers.items():
        parts.append(f"WHEN {name} = '{f}' THEN (CASE WHEN {z} >= 0 THEN '{hi}' ELSE '{lo}' END)")
    return f"(CASE {' '.join(parts)} ELSE (CASE WHEN {z} >= 0 THEN 'high ' ELSE 'low ' END) || {name} END)"


TOP_SQL = (
    _ZL + ", "
    + "cm AS (SELECT cluster, COUNT(*) AS size, " + ", ".join(f"AVG({c}) AS {c}" for c in FEATS) + " FROM zl GROUP BY cluster), "
    + "uu AS (" + " UNION ALL ".join(f"SELECT cluster, {i} AS idx, '{c}' AS name, {c} AS z FROM cm" for i, c in enumerate(FEATS)) + "), "
    + "u AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY ABS(z) DESC, idx) AS r FROM uu), "
    + "cr AS (" + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, ABS(COALESCE({_corr_sql(a, b)}, 0.0)) AS ac FROM zl"
        for a in FEATS for b in FEATS if a != b
    ) + "), "
    "c1 AS (SELECT cluster, r, name, z FROM u WHERE r = 1 AND ABS(z) >= 0.5), "
    "c2r AS (SELECT u.cluster, MIN(u.r) AS r FROM u JOIN c1 ON u.cluster = c1.cluster AND u.r > c1.r "
    "        JOIN cr ON cr.a = c1.name AND cr.b = u.name WHERE ABS(u.z) >= 0.5 AND cr.ac <= 0.6 GROUP BY u.cluster), "
    "c2 AS (SELECT u.cluster, u.r, u.name, u.z FROM u JOIN c2r USING (cluster, r)), "
    "c3r AS (SELECT u.cluster, MIN(u.r) AS r FROM u JOIN c1 ON u.cluster = c1.cluster JOIN c2 ON u.cluster = c2.cluster AND u.r > c2.r "
    "        JOIN cr x ON x.a = c1.name AND x.b = u.name JOIN cr y ON y.a = c2.name AND y.b = u.name "
    "        WHERE ABS(u.z) >= 0.5 AND x.ac <= 0.6 AND y.ac <= 0.6 GROUP BY u.cluster), "
    "c3 AS (SELECT u.cluster, u.r, u.name, u.z FROM u JOIN c3r USING (cluster, r)), "
    "top AS (SELECT cm.cluster, cm.size, "
    "        list_filter([c1.name, c2.name, c3.name], lambda t: t IS NOT NULL) AS top_features, "
    f"       concat_ws(', ', {_phrase_sql('c1.name', 'c1.z')}, {_phrase_sql('c2.name', 'c2.z')}, {_phrase_sql('c3.name', 'c3.z')}) AS summary "
    "        FROM cm LEFT JOIN c1 USING (cluster) LEFT JOIN c2 USING (cluster) LEFT JOIN c3 USING (cluster)) "
)


def _describe(spark, sf_dir):
    pm, zl = labeled_matrix(spark, sf_dir)
    corr = I.correlations(pm.matrix, FEATS)
    return pm, zl, I.describe(I.cluster_means(zl, FEATS), SPEC, corr)


@register("top_features", TOP_SQL + "SELECT cluster, top_features FROM top")
def top_features(spark, sf_dir):
    return _describe(spark, sf_dir)[2].select("cluster", "top_features")


@register("cluster_summary", TOP_SQL + "SELECT cluster, summary AS cluster_summary FROM top")
def cluster_summary(spark, sf_dir):
    return _describe(spark, sf_dir)[2].select("cluster", F.col("summary").alias("cluster_summary"))


@register(
    "descriptions",
    TOP_SQL + "SELECT cluster, CAST(size AS BIGINT) AS size, top_features, summary AS cluster_summary FROM top",
)
def descriptions(spark, sf_dir):
    pm, zl, raw = _describe(spark, sf_dir)
    sizes = L.sizes_of(zl)
    _, final = L.collapse_small(zl, 5, sizes)
    return L.descriptions_frame(raw, final).select("cluster", "size", "top_features", "cluster_summary")


@register(
    "tracks_with_summary",
    TOP_SQL + "SELECT zl.l_orderkey, zl.l_linenumber, zl.cluster, top.summary AS cluster_summary "
    "FROM zl JOIN top USING (cluster)",
)
def tracks_with_summary(spark, sf_dir):
    pm, zl, raw = _describe(spark, sf_dir)
    summaries = {r["cluster"]: r["summary"] for r in raw.select("cluster", "summary").collect()}
    t = L.tracks_frame(zl, zl.select("row_id", "cluster"), summaries, ("l_orderkey", "l_linenumber"))
    return t.select("l_orderkey", "l_linenumber", "cluster", "cluster_summary")


# ---- L1-L5 on embeddings / events -----------------------------------------

@register(
    "canonical_order",
    "WITH s AS (SELECT label AS cluster, COUNT(*) AS size, AVG(CAST(embedding[1] AS DOUBLE)) AS score FROM embeddings GROUP BY label) "
    "SELECT cluster AS old_cluster, CAST(ROW_NUMBER() OVER (ORDER BY size DESC, score) - 1 AS INTEGER) AS new_cluster, size FROM s",
)
def canonical_order(spark, sf_dir):
    """Size descending; ties broken by a given per-cluster score (mean of dimension 0)."""
    v = embedding_vectors(spark, sf_dir)
    st = v.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.avg(F.col("x")[0]).alias("score")).collect()
    sizes = {r["cluster"]: r["size"] for r in st}
    score = {r["cluster"]: r["score"] for r in st}
    k = max(sizes) + 1
    order = L.canonical_mapping(sizes, score, k)
    sz = v.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return sz.select(F.col("cluster").alias("old_cluster"), L.relabel(F.col("cluster"), order).alias("new_cluster"), "size")


COLLAPSE_MIN = 50


@register(
    "collapse_small",
    "WITH s AS (SELECT vec_id, label, COUNT(*) OVER (PARTITION BY label) AS n FROM embeddings) "
    f"SELECT vec_id AS row_id, CAST(CASE WHEN label < 0 OR n < {COLLAPSE_MIN} THEN -1 ELSE label END AS INTEGER) AS cluster FROM s",
)
def collapse_small(spark, sf_dir):
    v = embedding_vectors(spark, sf_dir).select("row_id", "cluster")
    out, _ = L.collapse_small(v, COLLAPSE_MIN)
    return out


DOMINANT_SHARE = 0.2


@register(
    "dominant_share",
    "WITH s AS (SELECT event_type, COUNT(*) AS size FROM events GROUP BY 1) "
    "SELECT event_type, size, ROUND(size * 1.0 / (SELECT COUNT(*) FROM events), 6) + 0.0 AS share, "
    f"size * 1.0 / (SELECT COUNT(*) FROM events) > {DOMINANT_SHARE} AS dominant FROM s",
)
def dominant_share(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_type")
    total = ev.count()
    s = ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("size"))
    share = F.col("size") / F.lit(float(total))
    return s.select("event_type", "size", round6(share).alias("share"), (share > DOMINANT_SHARE).alias("dominant"))


ALL_UNCLASSIFIED_MIN = 60


@register(
    "all_unclassified",
    "WITH s AS (SELECT label, COUNT(*) AS n FROM embeddings GROUP BY label) "
    f"SELECT CAST(SUM(n) AS BIGINT) AS total, CAST(SUM(CASE WHEN n < {ALL_UNCLASSIFIED_MIN} THEN n ELSE 0 END) AS BIGINT) AS unclassified, "
    f"SUM(CASE WHEN n < {ALL_UNCLASSIFIED_MIN} THEN n ELSE 0 END) = SUM(n) AS all_unclassified FROM s",
)
def all_unclassified(spark, sf_dir):
    v = embedding_vectors(spark, sf_dir).select("row_id", "cluster")
    out, _ = L.collapse_small(v, ALL_UNCLASSIFIED_MIN)
    return out.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum((F.col("cluster") < 0).cast("long")).alias("unclassified"),
    ).select("total", "unclassified", (F.col("unclassified") == F.col("total")).alias("all_unclassified"))


@register(
    "posterior_reorder",
    GMM_SQL
    + ", lab3 AS (SELECT row_id, arg_max(c, p) AS c FROM post WHERE k = 3 GROUP BY row_id), "
    "sz AS (SELECT c, COUNT(*) AS n FROM lab3 GROUP BY c), "
    "allc AS (SELECT DISTINCT c FROM post WHERE k = 3), "
    "ord AS (SELECT allc.c, ROW_NUMBER() OVER (ORDER BY COALESCE(sz.n, 0) DESC, allc.c) - 1 AS nc FROM allc LEFT JOIN sz USING (c)) "
    "SELECT post.row_id, list(ROUND(post.p, 6) + 0.0 ORDER BY ord.nc) AS posterior FROM post JOIN ord USING (c) "
    "WHERE post.k = 3 GROUP BY post.row_id",
)
def posterior_reorder(spark, sf_dir):
    """L2: posterior columns permuted into size-descending order (ties by old id)."""
    from tessera.operators import sweep as W
    from tessera.plans.q_select import bin_labels, gmm_from_labels

    lab = bin_labels(spark, sf_dir, 3).cache()
    g = gmm_from_labels(lab, 3, lab.count())
    post = W.gmm_assign(lab, g).cache()
    sizes = L.sizes_of(post)
    order = L.canonical_mapping(sizes, {c: float(c) for c in range(3)}, 3)
    out = post.select("row_id", L.reorder_posterior(F.col("posterior"), order).alias("posterior"))
    return out.select("row_id", F.transform("posterior", lambda p: F.round(p, 6) + F.lit(0.0)).alias("posterior"))



@register(
    "cluster_warnings",
    "WITH c AS (SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE -1 END AS cluster FROM orders), "
    "s AS (SELECT cluster, COUNT(*) AS size FROM c GROUP BY 1) "
    "SELECT 'dominant' AS kind, cluster FROM s WHERE cluster >= 0 AND size * 1.0 / (SELECT COUNT(*) FROM c) > 0.3 "
    "UNION ALL SELECT 'unstable', NULL",
)
def cluster_warnings(spark, sf_dir):
    """L4 and L6 through ``warnings_frame``: orders by status, limit 0.3, an ARI below the threshold."""
    o = table(spark, sf_dir, "orders")
    cluster = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(-1)
    sizes = o.groupBy(cluster.alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    return L.warnings_frame(sizes, 0.3, 5, 0.2).select("kind", "cluster")


@register("unclassified_warning", "SELECT 'unclassified' AS kind, -1 AS cluster, COUNT(*) || ' rows' AS rows_text FROM orders")
def unclassified_warning(spark, sf_dir):
    """L5 through ``warnings_frame``: every row of orders in the bucket -1; the other warnings stay away."""
    sizes = table(spark, sf_dir, "orders").groupBy(F.lit(-1).alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    w = L.warnings_frame(sizes, 0.3, 5, 0.2)
    return w.select("kind", "cluster", F.regexp_extract("text", r"All (\d+ rows)", 1).alias("rows_text"))
