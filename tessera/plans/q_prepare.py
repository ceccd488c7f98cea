"""Preprocessing queries (P2-P11) on the lineitem feature frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import round6
from tessera.operators import prepare as P
from tessera.plans.catalog import LINEITEM_SPEC, lineitem_features, lineitem_features_sql
from tessera.plans.registry import register

SPEC = LINEITEM_SPEC
FEATS = SPEC.features
IDS = ("l_orderkey", "l_linenumber")
EPS = SPEC.epsilon


# ---- SQL twins, built from the same spec --------------------------------

def _nmiss_sql() -> str:
    return " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in FEATS)


def ctes() -> str:
    """SQL twin of the lineitem preprocessing; CTE ``z`` is the scaled matrix."""
    return _ctes()


def _ctes() -> str:
    med = ", ".join(f"median({c}) AS med_{c}" for c in FEATS)
    imp = ", ".join(f"COALESCE({c}, med_{c}) AS {c}" for c in FEATS)
    tr = []
    for c in FEATS:
        kind = SPEC.transform_of(c)
        if kind == "logit":
            p = f"LEAST(GREATEST({c}, {EPS}), {1 - EPS})"
            tr.append(f"LN({p} / (1.0 - {p})) AS {c}")
        elif kind == "log":
            tr.append(f"LN({c}) AS {c}")
        else:
            tr.append(c)
    st = ", ".join(f"AVG({c}) AS mu_{c}, STDDEV_POP({c}) AS sd_{c}" for c in FEATS)
    z = ", ".join(
        f"({c} - mu_{c}) / (CASE WHEN sd_{c} > 0 THEN sd_{c} ELSE 1.0 END) AS {c}" for c in FEATS
    )
    return (
        f"WITH src AS ({lineitem_features_sql()}),\n"
        f"kept AS (SELECT * FROM src WHERE {_nmiss_sql()} <= {SPEC.max_missing}),\n"
        f"med AS (SELECT {med} FROM kept),\n"
        f"imp AS (SELECT l_orderkey, l_linenumber, l_returnflag, {imp} FROM kept CROSS JOIN med),\n"
        f"tr AS (SELECT l_orderkey, l_linenumber, l_returnflag, {', '.join(tr)} FROM imp),\n"
        f"st AS (SELECT {st} FROM tr),\n"
        f"z AS (SELECT l_orderkey, l_linenumber, l_returnflag, {z} FROM tr CROSS JOIN st)\n"
    )


def _r(cols) -> str:
    return ", ".join(f"ROUND({c}, 6) + 0.0 AS {c}" for c in cols)


def _spark_r(df: DataFrame, cols) -> DataFrame:
    return df.select(*IDS, *[round6(c).alias(c) for c in cols])


# ---- queries --------------------------------------------------------------

@register(
    "prep_missing_counts",
    f"WITH src AS ({lineitem_features_sql()}) "
    f"SELECT l_orderkey, l_linenumber, CAST({_nmiss_sql()} AS INTEGER) AS n_missing FROM src",
)
def prep_missing_counts(spark, sf_dir):
    df = P.cast_features(lineitem_features(spark, sf_dir), SPEC)
    return df.select(*IDS, P.missing_count(SPEC).cast("int").alias("n_missing"))


@register(
    "prep_drop_sparse",
    f"WITH src AS ({lineitem_features_sql()}) SELECT l_orderkey, l_linenumber, {_r(FEATS)} "
    f"FROM src WHERE {_nmiss_sql()} <= {SPEC.max_missing}",
)
def prep_drop_sparse(spark, sf_dir):
    kept, _ = P.split_sparse(P.cast_features(lineitem_features(spark, sf_dir), SPEC), SPEC)
    return _spark_r(kept, FEATS)


@register(
    "prep_dropped_rows",
    f"WITH src AS ({lineitem_features_sql()}) SELECT l_orderkey, l_linenumber "
    f"FROM src WHERE {_nmiss_sql()} > {SPEC.max_missing}",
)
def prep_dropped_rows(spark, sf_dir):
    _, dropped = P.split_sparse(P.cast_features(lineitem_features(spark, sf_dir), SPEC), SPEC)
    return dropped.select(*IDS)


def _kept(spark, sf_dir):
    kept, _ = P.split_sparse(P.cast_features(lineitem_features(spark, sf_dir), SPEC), SPEC)
    return kept


@register("prep_impute_median", _ctes() + f"SELECT l_orderkey, l_linenumber, {_r(FEATS)} FROM imp")
def prep_impute_median(spark, sf_dir):
    kept = _kept(spark, sf_dir)
    medians, _, _ = P.exact_medians(kept, list(FEATS))
    return _spark_r(P.impute(kept, medians), FEATS)


@register(
    "prep_imputed_counts",
    f"WITH src AS ({lineitem_features_sql()}), kept AS (SELECT * FROM src WHERE {_nmiss_sql()} <= {SPEC.max_missing}), "
    "cnt AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS imputed FROM kept"
        for c in FEATS
    ) + ") SELECT feature, imputed FROM cnt WHERE imputed > 0",
)
def prep_imputed_counts(spark, sf_dir):
    kept = _kept(spark, sf_dir)
    stacked = kept.select(
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(c).isNull().cast("long").alias("miss")) for c in FEATS
        ])).alias("s")
    )
    return (
        stacked.groupBy(F.col("s.feature").alias("feature"))
        .agg(F.sum("s.miss").cast("long").alias("imputed"))
        .where(F.col("imputed") > 0)
    )


def _transformed(spark, sf_dir):
    kept = _kept(spark, sf_dir)
    medians, _, _ = P.exact_medians(kept, list(FEATS))
    return P.transform(P.impute(kept, medians), SPEC)


@register("prep_logit", _ctes() + f"SELECT l_orderkey, l_linenumber, {_r(SPEC.logit)} FROM tr")
def prep_logit(spark, sf_dir):
    return _spark_r(_transformed(spark, sf_dir), SPEC.logit)


@register("prep_log", _ctes() + f"SELECT l_orderkey, l_linenumber, {_r(SPEC.log)} FROM tr")
def prep_log(spark, sf_dir):
    return _spark_r(_transformed(spark, sf_dir), SPEC.log)


@register("prep_zscore", _ctes() + f"SELECT l_orderkey, l_linenumber, {_r(FEATS)} FROM z")
def prep_zscore(spark, sf_dir):
    pm = P.prepare_matrix(lineitem_features(spark, sf_dir), SPEC)
    return _spark_r(pm.matrix, FEATS)


def _roundtrip_sql() -> str:
    inv = []
    for c in FEATS:
        kind = SPEC.transform_of(c)
        if kind == "logit":
            inv.append(f"LEAST(GREATEST({c}, {EPS}), {1 - EPS}) AS {c}")
        else:
            inv.append(c)
    return _ctes() + f"SELECT l_orderkey, l_linenumber, {_r(FEATS)} FROM (SELECT l_orderkey, l_linenumber, {', '.join(inv)} FROM imp)"


@register("prep_roundtrip", _roundtrip_sql())
def prep_roundtrip(spark, sf_dir):
    """Inverse transform of the scaled matrix: recovers the (clipped) imputed values."""
    pm = P.prepare_matrix(lineitem_features(spark, sf_dir), SPEC)
    back = P.inverse_transform(pm.matrix, SPEC, pm.scaler)
    return _spark_r(back, FEATS)
