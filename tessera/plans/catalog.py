"""Inputs derived from the driver tables, each with its SQL twin.

The driver tables hold no NULLs, so the lineitem feature frame injects them
by a fixed rule on ``l_linenumber`` (every row is kept; nothing is filtered):

    l_discount       NULL when l_linenumber in (1, 6, 7)
    l_tax            NULL when l_linenumber in (2, 6, 7)
    l_extendedprice  NULL when l_linenumber in (3, 6, 7)
    l_quantity       NULL when l_linenumber in (4, 7)

so line 7 has four missing cells (dropped), line 6 three (kept and imputed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table
from tessera.spec import FeatureSpec

# The null-injection rule above.
NULL_LINES = {
    "l_discount": (1, 6, 7),
    "l_tax": (2, 6, 7),
    "l_extendedprice": (3, 6, 7),
    "l_quantity": (4, 7),
}

LINEITEM_SPEC = FeatureSpec(
    features=("l_discount", "l_tax", "l_extendedprice", "l_quantity"),
    logit=("l_discount", "l_tax"),
    log=("l_extendedprice",),
    ids=("l_orderkey", "l_linenumber", "l_returnflag"),
    qualifiers={"l_extendedprice": ("expensive", "cheap")},
)


def lineitem_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cols = [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_returnflag")]
    for c, lines in NULL_LINES.items():
        cols.append(F.when(F.col("l_linenumber").isin(*lines), F.lit(None).cast("double")).otherwise(F.col(c)).alias(c))
    return li.select(*cols)


def lineitem_features_sql() -> str:
    parts = ["l_orderkey", "l_linenumber", "l_returnflag"]
    for c, lines in NULL_LINES.items():
        parts.append(f"CASE WHEN l_linenumber IN ({', '.join(map(str, lines))}) THEN NULL ELSE {c} END AS {c}")
    return f"SELECT {', '.join(parts)} FROM lineitem"


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_id, cluster, x array<double>)`` from ``embeddings``; label is the cluster."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("row_id"),
        F.col("label").alias("cluster"),
        F.transform("embedding", lambda v: v.cast("double")).alias("x"),
    )


#: Long form of the embeddings in DuckDB: one row per (vector, dimension).
EMB_LONG_SQL = (
    "SELECT vec_id AS row_id, label AS cluster, u.j - 1 AS j, CAST(u.v AS DOUBLE) AS v "
    "FROM embeddings, UNNEST(embedding) WITH ORDINALITY AS u(v, j)"
)

#: The label used as "noise" when a query needs HDBSCAN-style -1 labels.
NOISE_SOURCE_LABEL = 9


def embedding_vectors_with_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = embedding_vectors(spark, sf_dir)
    return v.withColumn(
        "cluster", F.when(F.col("cluster") == NOISE_SOURCE_LABEL, F.lit(-1)).otherwise(F.col("cluster"))
    )
