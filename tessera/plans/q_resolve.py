"""Resolution queries.

Tracks are the ``documents`` (external id = doc id as text); the hop-1
catalog is ``pages`` (internal id = page id, external id = the URL's last
path segment, last page wins); the hop-2 feature table is ``labels`` keyed by
the internal id, with ``quality`` and ``toxic`` as features.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import id_from_href
from tessera.operators import resolve as R
from tessera.plans.q_sources import HREF_SQL
from tessera.plans.registry import register
from tessera.sources.tables import table

FEATURES = ["quality", "toxic"]


def _tracks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("row_id"), F.col("doc_id").cast("string").alias("spotify_id"), "doc_id", "source")


def _mapping(spark, sf_dir):
    return R.catalog_mapping(table(spark, sf_dir, "pages"), "url", "page_id", "page_id")


def _feats(spark, sf_dir):
    return R.feature_table(table(spark, sf_dir, "labels"), "doc_id", FEATURES, "doc_id")


_M = (
    f"m0 AS (SELECT page_id, {HREF_SQL.format(c='url')} AS ext_id FROM pages), "
    "m AS (SELECT ext_id, CAST(max_by(page_id, page_id) AS VARCHAR) AS internal_id FROM m0 WHERE ext_id IS NOT NULL GROUP BY ext_id), "
    "f AS (SELECT CAST(doc_id AS VARCHAR) AS internal_id, CAST(max_by(quality, doc_id) AS DOUBLE) AS quality, "
    "      CAST(max_by(toxic, doc_id) AS DOUBLE) AS toxic FROM labels GROUP BY doc_id), "
    "t AS (SELECT doc_id, source, CAST(doc_id AS VARCHAR) AS ext_id FROM documents), "
    "r AS (SELECT t.doc_id, t.source, f.quality, f.toxic FROM t JOIN m USING (ext_id) JOIN f USING (internal_id)) "
)


@register("href_to_id", f"SELECT page_id, {HREF_SQL.format(c='url')} AS ext_id FROM pages")
def href_to_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", id_from_href("url").alias("ext_id"))


@register("resolve_last_wins", "WITH " + _M + "SELECT ext_id, internal_id FROM m")
def resolve_last_wins(spark, sf_dir):
    return _mapping(spark, sf_dir)


@register(
    "distinct_internal_ids",
    "WITH " + _M + "SELECT DISTINCT m.internal_id FROM (SELECT DISTINCT ext_id FROM t) JOIN m USING (ext_id)",
)
def distinct_internal_ids(spark, sf_dir):
    return R.distinct_internal_ids(_tracks(spark, sf_dir), _mapping(spark, sf_dir))


@register("two_hop_resolve", "WITH " + _M + "SELECT doc_id, source, quality, toxic FROM r")
def two_hop_resolve(spark, sf_dir):
    res = R.resolve_features(_tracks(spark, sf_dir), _mapping(spark, sf_dir), _feats(spark, sf_dir), FEATURES,
                             identity=["doc_id", "source"])
    return res.features.select("doc_id", "source", *FEATURES)


@register(
    "resolve_dropped",
    "WITH " + _M + "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM r)",
)
def resolve_dropped(spark, sf_dir):
    res = R.resolve_features(_tracks(spark, sf_dir), _mapping(spark, sf_dir), _feats(spark, sf_dir), FEATURES,
                             identity=["doc_id", "source"])
    return res.dropped.select("doc_id", "source")


@register(
    "coverage_report",
    "WITH " + _M + "SELECT (SELECT COUNT(*) FROM documents) AS total, (SELECT COUNT(*) FROM r) AS resolved, "
    "(SELECT COUNT(*) FROM documents) - (SELECT COUNT(*) FROM r) AS dropped",
)
def coverage_report(spark, sf_dir):
    """One aggregate over the tracks left-joined to the resolved ids."""
    t = _tracks(spark, sf_dir)
    res = R.resolve_features(t, _mapping(spark, sf_dir), _feats(spark, sf_dir), FEATURES, identity=["doc_id", "source"])
    hit = res.features.select("row_id", F.lit(1).alias("_hit"))
    return t.select("row_id").join(hit, "row_id", "left").agg(
        F.count(F.lit(1)).alias("total"), F.count("_hit").alias("resolved")
    ).select("total", "resolved", (F.col("total") - F.col("resolved")).alias("dropped"))
