"""Export queries.

Groups for the export frames: ``documents`` labelled with their ``labels.quality``
(-1 when a document has no label row); summary "quality <q>" / "unclassified".
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import is_safe_name, sql_whitespace_literal
from tessera.operators import postprocess as L
from tessera.plans.registry import register
from tessera.sinks import export as E
from tessera.sources.tables import table

WS = sql_whitespace_literal()


def _safe_sql(c: str) -> str:
    t = f"trim({c}, {WS})"
    return (
        f"COALESCE({t} <> '' AND NOT starts_with({t}, '.') AND NOT ends_with({t}, '.') "
        f"AND NOT regexp_matches({t}, '[/\\\\:*?\"<>|]'), FALSE)"
    )


@register(
    "valid_names",
    f"SELECT 'page' AS kind, page_id AS key, {_safe_sql('url')} AS is_safe FROM pages UNION ALL "
    f"SELECT 'customer' AS kind, c_custkey AS key, {_safe_sql('c_name')} AS is_safe FROM customer",
)
def valid_names(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("key"), is_safe_name("url").alias("is_safe"))
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), is_safe_name("c_name").alias("is_safe"))
    return p.unionByName(c)


NAME_SHIFT = 5  # naming keys = n_nationkey - 5, cluster ids = c_nationkey - 1


@register(
    "resolve_names",
    "WITH ids AS (SELECT DISTINCT c_nationkey - 1 AS cluster FROM customer), "
    f"nm AS (SELECT n_nationkey - {NAME_SHIFT} AS cluster, n_name AS name FROM nation) "
    "SELECT CAST(ids.cluster AS INTEGER) AS cluster, COALESCE(NULLIF(nm.name, ''), "
    "CASE WHEN ids.cluster = -1 THEN 'Unclassified' ELSE 'cluster_' || CAST(ids.cluster AS VARCHAR) END) AS name "
    "FROM ids LEFT JOIN nm USING (cluster)",
)
def resolve_names(spark, sf_dir):
    ids = [r[0] for r in table(spark, sf_dir, "customer").select((F.col("c_nationkey") - 1).alias("c")).distinct().collect()]
    naming = {int(r[0]) - NAME_SHIFT: r[1] for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()}
    rows = [(int(c), E.unclassified_name(naming) if c == -1 else E.resolve_name(int(c), naming)) for c in ids]
    return spark.createDataFrame(rows, "cluster int, name string")


@register(
    "duplicate_names",
    "SELECT r.r_name AS name, COUNT(*) AS n_clusters FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey "
    "GROUP BY r.r_name HAVING COUNT(*) > 1",
)
def duplicate_names(spark, sf_dir):
    """Cluster = nation, name = its region: the names that several clusters share."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    named = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("cluster"), F.col("r_name").alias("name"))
    return named.groupBy("name").agg(F.count(F.lit(1)).alias("n_clusters")).where(F.col("n_clusters") > 1)


def _tracks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    t = d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("row_id"),
        F.col("doc_id").cast("string").alias("spotify_id"),
        F.col("source").alias("title"),
        F.col("lang").alias("artist"),
        F.coalesce(F.col("quality"), F.lit(-1)).cast("int").alias("cluster"),
    )
    summaries = {0: "quality 0", 1: "quality 1"}
    return t.withColumn("cluster_summary", F.element_at(L.summary_map(summaries), F.col("cluster")))


_T = (
    "t AS (SELECT CAST(d.doc_id AS VARCHAR) AS spotify_id, d.source AS title, d.lang AS artist, "
    "CAST(COALESCE(l.quality, -1) AS INTEGER) AS cluster FROM documents d LEFT JOIN labels l USING (doc_id)), "
    "x AS (SELECT 'spotify:track:' || spotify_id AS \"Track URI\", title AS \"Track Name\", artist AS \"Artist Name(s)\", "
    "cluster AS \"Cluster\", CASE WHEN cluster = -1 THEN 'unclassified' ELSE 'quality ' || CAST(cluster AS VARCHAR) END AS \"Cluster Summary\", "
    "spotify_id FROM t) "
)
_COLS = '"Track URI", "Track Name", "Artist Name(s)", "Cluster", "Cluster Summary"'


@register("export_frame", "WITH " + _T + f"SELECT {_COLS} FROM x WHERE \"Cluster\" >= 0")
def export_frame(spark, sf_dir):
    f = E.export_frame(_tracks(spark, sf_dir))
    return f.where(F.col("Cluster") >= 0).drop("row_id")


@register(
    "export_with_features",
    "WITH " + _T + ", ft AS (SELECT CAST(doc_id AS VARCHAR) AS spotify_id, toxic FROM labels) "
    f"SELECT {_COLS}, ft.toxic FROM x LEFT JOIN ft USING (spotify_id)",
)
def export_with_features(spark, sf_dir):
    feats = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("spotify_id"), "toxic")
    return E.export_frame(_tracks(spark, sf_dir), feats, ["toxic"]).drop("row_id")


@register("combined_frame", "WITH " + _T + f"SELECT {_COLS} FROM x")
def combined_frame(spark, sf_dir):
    return E.export_frame(_tracks(spark, sf_dir)).drop("row_id")


@register(
    "rename_table",
    "WITH " + _T + "SELECT \"Cluster\" AS cluster, COUNT(*) AS size, ANY_VALUE(\"Cluster Summary\") AS cluster_summary, "
    "CASE WHEN \"Cluster\" = -1 THEN 'Unclassified' ELSE 'cluster_' || CAST(\"Cluster\" AS VARCHAR) END AS default_name "
    "FROM x GROUP BY \"Cluster\"",
)
def rename_table(spark, sf_dir):
    t = _tracks(spark, sf_dir)
    desc = t.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.first("cluster_summary").alias("cluster_summary"))
    return E.rename_table(desc)


@register(
    "name_faults",
    "WITH c AS (SELECT n_nationkey AS cluster, CASE WHEN n_nationkey % 6 = 0 THEN r_name || '/' WHEN n_nationkey % 6 = 1 THEN r_name ELSE n_name END AS name "
    "FROM nation JOIN region ON r_regionkey = n_regionkey) "
    "SELECT 'unsafe' AS problem, [cluster] AS clusters, name FROM c WHERE name LIKE '%/%' "
    "UNION ALL SELECT 'not unique', list(cluster ORDER BY cluster), name FROM c GROUP BY name HAVING COUNT(*) > 1",
)
def name_faults(spark, sf_dir):
    """E3 through ``problems_frame``: nations as clusters; a sixth has an unsafe name, a sixth its region's, which several share."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    k = F.col("n_nationkey") % 6
    name = F.when(k == 0, F.concat("r_name", F.lit("/"))).when(k == 1, F.col("r_name")).otherwise(F.col("n_name"))
    named = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("cluster"), name.alias("name"))
    return E.problems_frame(named)
