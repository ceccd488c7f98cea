"""Source queries (S3-S6, S8-S10) over ``documents``, ``pages`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import id_from_href, remove_prefix, sql_whitespace_literal, strip_ws
from tessera.plans.registry import register
from tessera.sources.content import explode_content
from tessera.sources.delimited import clean_tracks, preview
from tessera.sources.tables import table
from tessera.spec import SRC_ARTIST_NAME, SRC_TRACK_NAME, SRC_TRACK_URI, TRACK_URI_PREFIX

WS = sql_whitespace_literal()
HTTPS = "https://"
PREVIEW_ROWS = 20

#: SQL twin of ``id_from_href``.
HREF_SQL = (
    "CASE WHEN {c} IS NULL OR {c} = '' THEN NULL ELSE NULLIF(regexp_extract("
    "regexp_replace(regexp_replace({c}, '(?s)\\?.*$', ''), '/+$', ''), '([^/]*)$', 1), '') END"
)


@register(
    "track_projection",
    "SELECT CAST(doc_id AS VARCHAR) AS spotify_id, source AS title, lang AS artist FROM documents",
)
def track_projection(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("spotify_id"), F.col("source").alias("title"), F.col("lang").alias("artist"))


@register(
    "uri_prefix_strip",
    f"SELECT page_id, CASE WHEN starts_with(url, '{HTTPS}') THEN substr(url, {len(HTTPS) + 1}) ELSE url END AS stripped FROM pages",
)
def uri_prefix_strip(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", remove_prefix(F.col("url"), HTTPS).alias("stripped"))


@register(
    "unicode_trim",
    f"SELECT doc_id, CAST(length(trim(text, {WS})) AS INTEGER) AS n_chars, md5(trim(text, {WS})) AS digest FROM documents",
)
def unicode_trim(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    s = strip_ws(F.col("text"))
    return d.select("doc_id", F.length(s).alias("n_chars"), F.md5(s).alias("digest"))


@register(
    "drop_blank_ids",
    f"SELECT page_id, id FROM (SELECT page_id, {HREF_SQL.format(c='url')} AS id FROM pages) WHERE id IS NOT NULL AND id <> ''",
)
def drop_blank_ids(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", id_from_href("url").alias("id"))
    return p.where(F.col("id").isNotNull() & (F.col("id") != ""))


@register("library_count", "SELECT COUNT(*) AS n_tracks FROM documents")
def library_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_tracks"))


@register(
    "preview_head_tail",
    f"(SELECT doc_id, source, 'head' AS part FROM documents ORDER BY doc_id LIMIT {PREVIEW_ROWS // 2}) UNION ALL "
    f"(SELECT doc_id, source, 'tail' AS part FROM documents ORDER BY doc_id DESC LIMIT {PREVIEW_ROWS // 2})",
)
def preview_head_tail(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return preview(d, PREVIEW_ROWS, order_col="doc_id").select("doc_id", "source", "part")


ITEM = T.StructType([T.StructField("id", T.StringType()), T.StructField("href", T.StringType())])


@register(
    "json_content_rows",
    "SELECT event_id, CAST(u.item ->> 'id' AS VARCHAR) AS id, CAST(u.item ->> 'href' AS VARCHAR) AS href "
    "FROM events, UNNEST(CASE WHEN json_type(props -> 'content') = 'ARRAY' THEN CAST(props -> 'content' AS JSON[]) ELSE [] END) AS u(item)",
)
def json_content_rows(spark, sf_dir):
    """Bodies without a ``content`` list give no rows."""
    ev = table(spark, sf_dir, "events")
    return explode_content(ev, "props", ITEM, ["event_id"])


@register("json_field_rows", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field_rows(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@register(
    "clean_track_rows",
    "SELECT source AS title, lang AS artist, CAST(doc_id AS VARCHAR) AS spotify_id FROM documents WHERE doc_id % 5 <> 0",
)
def clean_track_rows(spark, sf_dir):
    """S3-S6 through ``clean_tracks``: names with edge spaces, ids with the prefix.

    One row in five has a blank id (half of them the bare prefix) and is dropped.
    """
    d = table(spark, sf_dir, "documents")
    uri = F.when(F.col("doc_id") % 10 == 0, F.lit("  ")).when(F.col("doc_id") % 5 == 0, F.lit(TRACK_URI_PREFIX))
    raw = d.select(
        F.concat(F.lit(" \t"), "source", F.lit(" ")).alias(SRC_TRACK_NAME),
        F.concat(F.lit("\n"), "lang", F.lit(" ")).alias(SRC_ARTIST_NAME),
        uri.otherwise(F.concat(F.lit(" "), F.lit(TRACK_URI_PREFIX), F.col("doc_id").cast("string"), F.lit(" "))).alias(SRC_TRACK_URI),
    )
    return clean_tracks(raw)


@register(
    "json_body_items",
    "SELECT page_id, k AS part, page_id || '-' || k AS id, url || '/' || k AS href FROM pages, range(1, 4) r(k) WHERE page_id % 4 <> 0",
)
def json_body_items(spark, sf_dir):
    """S10 on bodies made from ``pages``: three items each; one body in four has no list and gives no rows."""
    p = table(spark, sf_dir, "pages")
    items = F.array(*[F.struct(F.concat_ws("-", "page_id", F.lit(k)).alias("id"), F.concat(F.col("url"), F.lit(f"/{k}")).alias("href")) for k in (1, 2, 3)])
    odd = F.when(F.col("page_id") % 8 == 0, F.lit('{"content": {"id": 1}}')).otherwise(F.lit("not json"))
    body = F.when(F.col("page_id") % 4 == 0, odd).otherwise(F.to_json(F.struct(items.alias("content"))))
    rows = explode_content(p.select("page_id", body.alias("body")), "body", ITEM, ["page_id"])
    return rows.select("page_id", F.element_at(F.split("id", "-"), -1).cast("bigint").alias("part"), "id", "href")
