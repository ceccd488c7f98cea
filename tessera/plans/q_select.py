"""Model-selection queries (C3-C6, C11) on curves derived from ``embeddings``.

Labelings for k = 2..5 come from equal-width bins of the first embedding
dimension (bin edges from the global min/max), so every curve is computed
from the table itself and is reproducible in SQL.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.numeric import round6
from tessera.operators import quality as Q
from tessera.operators import select as S
from tessera.operators import sweep as W
from tessera.plans.catalog import embedding_vectors
from tessera.plans.registry import register

KS = (2, 3, 4, 5)
D = 64
POSTERIOR_K = 3


def _bin(k: int, mn: float, mx: float):
    return F.least(F.lit(k - 1), F.floor((F.col("x")[0] - F.lit(mn)) / F.lit(mx - mn) * F.lit(k)).cast("int"))


def _edges(v):
    mm = v.agg(F.min(F.col("x")[0]).alias("mn"), F.max(F.col("x")[0]).alias("mx")).first()
    return float(mm["mn"]), float(mm["mx"])


def bin_labels(spark, sf_dir, k: int):
    v = embedding_vectors(spark, sf_dir)
    mn, mx = _edges(v)
    return v.withColumn("cluster", _bin(k, mn, mx))


def multi_bin_labels(spark, sf_dir, ks):
    """``(row_id, x, labs)`` with one equal-width labeling per k."""
    v = embedding_vectors(spark, sf_dir)
    mn, mx = _edges(v)
    return v.select("row_id", "x", F.array(*[_bin(k, mn, mx) for k in ks]).alias("labs"))


_E = "e AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
_MM = "mm AS (SELECT MIN(x[1]) AS mn, MAX(x[1]) AS mx FROM e)"
_KS = "ks AS (SELECT UNNEST([" + ", ".join(map(str, KS)) + "]) AS k)"
_LAB = (
    "lab AS (SELECT ks.k, e.row_id, e.x, LEAST(ks.k - 1, CAST(FLOOR((e.x[1] - mm.mn) / (mm.mx - mm.mn) * ks.k) AS INTEGER)) AS c "
    "FROM e, mm, ks)"
)
_BASE = f"WITH {_E}, {_MM}, {_KS}, {_LAB}"


# ---- C11: rank-sum choice over silhouette / CH curves ----------------------

def _sil_ch_curves(spark, sf_dir) -> list[tuple[int, float, float]]:
    multi = multi_bin_labels(spark, sf_dir, KS).cache()
    n = multi.count()
    sils = Q.silhouettes(multi, n)
    out = []
    for m, k in enumerate(KS):
        ch = Q.quality_scalars(multi.select("row_id", "x", F.col("labs")[m].alias("cluster")), D)["ch"]
        out.append((k, sils[m], float(ch)))
    multi.unpersist()
    return out


SIL_CH_SQL = (
    _BASE + ", "
    "pd AS (SELECT a.k, a.row_id, a.c AS own, b.c AS other, AVG(list_distance(a.x, b.x)) AS md "
    "       FROM lab a JOIN lab b ON a.k = b.k AND a.row_id <> b.row_id GROUP BY 1, 2, 3, 4), "
    "ab AS (SELECT k, row_id, MAX(CASE WHEN other = own THEN md END) AS a, MIN(CASE WHEN other <> own THEN md END) AS b "
    "       FROM pd GROUP BY 1, 2), "
    "sil AS (SELECT lab.k, AVG(CASE WHEN ab.a IS NULL OR ab.b IS NULL THEN 0.0 WHEN GREATEST(ab.a, ab.b) = 0 THEN 0.0 "
    "        ELSE (ab.b - ab.a) / GREATEST(ab.a, ab.b) END) AS sil FROM lab LEFT JOIN ab ON ab.k = lab.k AND ab.row_id = lab.row_id GROUP BY lab.k), "
    "lg AS (SELECT lab.k, lab.row_id, lab.c, u.j, CAST(u.v AS DOUBLE) AS v FROM lab, UNNEST(lab.x) WITH ORDINALITY AS u(v, j)), "
    "cm AS (SELECT k, c, j, AVG(v) AS m, COUNT(*) AS nk FROM lg GROUP BY 1, 2, 3), "
    "gm AS (SELECT k, j, AVG(v) AS g FROM lg GROUP BY 1, 2), "
    "w AS (SELECT lg.k, SUM((lg.v - cm.m) * (lg.v - cm.m)) AS w FROM lg JOIN cm USING (k, c, j) GROUP BY 1), "
    "b AS (SELECT cm.k, SUM(cm.nk * (cm.m - gm.g) * (cm.m - gm.g)) AS b FROM cm JOIN gm USING (k, j) GROUP BY 1), "
    "kn AS (SELECT k, COUNT(DISTINCT c) AS kk, COUNT(DISTINCT row_id) AS n FROM lab GROUP BY 1), "
    "ch AS (SELECT w.k, CASE WHEN w = 0 THEN 1.0 ELSE (b / (kk - 1)) / (w / (n - kk)) END AS ch "
    "       FROM w JOIN b USING (k) JOIN kn USING (k)), "
    "curves AS (SELECT sil.k, sil.sil, ch.ch FROM sil JOIN ch USING (k)), "
    "rk AS (SELECT k, ROW_NUMBER() OVER (ORDER BY sil DESC, k) + ROW_NUMBER() OVER (ORDER BY ch DESC, k) AS rs FROM curves) "
)


@register(
    "choose_k_rank_sum",
    SIL_CH_SQL + "SELECT CAST(k AS INTEGER) AS chosen_k FROM rk ORDER BY rs, k DESC LIMIT 1",
)
def choose_k_rank_sum(spark, sf_dir):
    curves = spark.createDataFrame(_sil_ch_curves(spark, sf_dir), "k int, sil double, ch double")
    return S.choose_k_rank_sum_frame(curves)


@register(
    "kmeans_style_curves",
    SIL_CH_SQL + "SELECT CAST(k AS INTEGER) AS k, ROUND(sil, 6) + 0.0 AS silhouette, ROUND(ch, 6) + 0.0 AS ch_index FROM curves",
)
def kmeans_style_curves(spark, sf_dir):
    rows = _sil_ch_curves(spark, sf_dir)
    df = spark.createDataFrame(rows, "k int, sil double, ch double")
    return df.select("k", round6("sil").alias("silhouette"), round6("ch").alias("ch_index"))


# ---- C3-C6: mixtures whose parameters come from the labelings --------------

def gmm_from_labels(lab, k: int, n: int) -> W.Gmm:
    """M-step from hard labels (diagonal covariances), as one aggregate."""
    long = lab.select("cluster", F.posexplode("x").alias("j", "v"))
    st = long.groupBy("cluster", "j").agg(
        F.count(F.lit(1)).alias("nk"), F.sum("v").alias("s1"), F.sum(F.col("v") * F.col("v")).alias("s2")
    ).collect()
    nk = np.zeros(k)
    s1 = np.zeros((k, D))
    s2 = np.zeros((k, D))
    for r in st:
        c, j = r["cluster"], r["j"]
        nk[c] = r["nk"]
        s1[c, j] = r["s1"]
        s2[c, j] = r["s2"]
    means = s1 / nk[:, None]
    covs = s2 / nk[:, None] - means * means + 1e-6
    return W.Gmm(k=k, weights=nk / n, means=means, covs=covs, cov_type="diag")


def _bic_icl_curves(spark, sf_dir):
    out = []
    for k in KS:
        lab = bin_labels(spark, sf_dir, k).cache()
        n = lab.count()
        g = gmm_from_labels(lab, k, n)
        ll, ent = W.gmm_scores(lab, {0: g})[0]
        b = W.bic(ll, g.n_params(), n)
        out.append((k, b, W.icl(b, ent)))
        lab.unpersist()
    return out


GMM_SQL = (
    _BASE + ", "
    "lg AS (SELECT lab.k, lab.row_id, lab.c, CAST(u.j AS INTEGER) AS j, CAST(u.v AS DOUBLE) AS v FROM lab, UNNEST(lab.x) WITH ORDINALITY AS u(v, j)), "
    "nn AS (SELECT COUNT(*) AS n FROM e), "
    "st AS (SELECT k, c, j, AVG(v) AS mu, VAR_POP(v) + 1e-6 AS var FROM lg GROUP BY 1, 2, 3), "
    "wt AS (SELECT k, c, COUNT(*) / (SELECT n FROM nn) AS w FROM lab GROUP BY 1, 2), "
    "lp AS (SELECT lg.k, lg.row_id, st.c, SUM(-0.5 * (LN(2 * PI()) + LN(st.var) + (lg.v - st.mu) * (lg.v - st.mu) / st.var)) AS l "
    "       FROM lg JOIN st ON st.k = lg.k AND st.j = lg.j GROUP BY 1, 2, 3), "
    "lw AS (SELECT lp.k, lp.row_id, lp.c, lp.l + LN(wt.w) AS l FROM lp JOIN wt USING (k, c)), "
    "mx AS (SELECT k, row_id, MAX(l) AS m FROM lw GROUP BY 1, 2), "
    "lse AS (SELECT lw.k, lw.row_id, mx.m + LN(SUM(EXP(lw.l - mx.m))) AS lse FROM lw JOIN mx USING (k, row_id) GROUP BY lw.k, lw.row_id, mx.m), "
    "post AS (SELECT lw.k, lw.row_id, lw.c, EXP(lw.l - lse.lse) AS p FROM lw JOIN lse USING (k, row_id)), "
    "ll AS (SELECT k, SUM(lse) AS ll FROM lse GROUP BY 1), "
    "ent AS (SELECT k, SUM(p * LN(GREATEST(p, 1e-12))) AS ent FROM post GROUP BY 1), "
    "curves AS (SELECT ll.k, -2 * ll.ll + (2 * ll.k * 64 + ll.k - 1) * LN((SELECT n FROM nn)) AS bic, ent.ent FROM ll JOIN ent USING (k)), "
    "cv AS (SELECT k, bic, bic - 2 * ent AS icl FROM curves) "
)


@register("bic_formula", GMM_SQL + "SELECT CAST(k AS INTEGER) AS k, ROUND(bic, 6) + 0.0 AS bic FROM cv")
def bic_formula(spark, sf_dir):
    rows = _bic_icl_curves(spark, sf_dir)
    return spark.createDataFrame(rows, "k int, bic double, icl double").select("k", round6("bic").alias("bic"))


@register("posterior_icl", GMM_SQL + "SELECT CAST(k AS INTEGER) AS k, ROUND(icl, 6) + 0.0 AS icl FROM cv")
def posterior_icl(spark, sf_dir):
    rows = _bic_icl_curves(spark, sf_dir)
    return spark.createDataFrame(rows, "k int, bic double, icl double").select("k", round6("icl").alias("icl"))


CHOOSE_SQL = (
    GMM_SQL + ", "
    "o AS (SELECT k, bic, icl, LAG(k) OVER (ORDER BY k) AS pk, LAG(bic) OVER (ORDER BY k) AS pb FROM cv), "
    "f AS (SELECT *, COALESCE(pk = k - 1 AND pb - bic <= 10.0, FALSE) AS passes, "
    "      FIRST_VALUE(k) OVER (ORDER BY bic, k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS bb, "
    "      FIRST_VALUE(k) OVER (ORDER BY icl, k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ib FROM o), "
    "g AS (SELECT MAX(CASE WHEN k <= bb AND NOT passes THEN k END) AS bc, MAX(ib) AS ib FROM f), "
    "h AS (SELECT g.bc, g.ib, (SELECT bic FROM cv WHERE k = g.ib) AS b_ib, (SELECT bic FROM cv WHERE k = g.bc) AS b_bc FROM g) "
)


@register(
    "choose_k_bic_icl",
    CHOOSE_SQL + "SELECT CAST(CASE WHEN ib <> bc AND b_ib - b_bc <= 10.0 THEN ib ELSE bc END AS INTEGER) AS chosen_k FROM h",
)
def choose_k_bic_icl(spark, sf_dir):
    curves = spark.createDataFrame(_bic_icl_curves(spark, sf_dir), "k int, bic double, icl double")
    return S.choose_k_bic_icl_frame(curves)


@register(
    "posterior_argmax",
    GMM_SQL + f"SELECT row_id, CAST(arg_max(c, p) AS INTEGER) AS cluster FROM post WHERE k = {POSTERIOR_K} GROUP BY row_id",
)
def posterior_argmax(spark, sf_dir):
    lab = bin_labels(spark, sf_dir, POSTERIOR_K).cache()
    n = lab.count()
    g = gmm_from_labels(lab, POSTERIOR_K, n)
    return W.gmm_assign(lab, g).select("row_id", "cluster")
