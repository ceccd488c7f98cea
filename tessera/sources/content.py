"""JSON response bodies -> rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def content_items(body: Column, item_schema: T.StructType, key: str = "content") -> Column:
    """Array of items under ``key``; a body of any other shape (or invalid JSON) gives []."""
    schema = T.StructType([T.StructField(key, T.ArrayType(item_schema), True)])
    parsed = F.from_json(body, schema, {"mode": "PERMISSIVE"})
    return F.coalesce(parsed[key], F.array().cast(T.ArrayType(item_schema)))


def explode_content(df: DataFrame, body_col: str, item_schema: T.StructType, keep: list[str], key: str = "content") -> DataFrame:
    """One row per item of each body (``keep`` columns carried along)."""
    return df.select(*keep, F.explode(content_items(F.col(body_col), item_schema, key)).alias("item")).select(
        *keep, "item.*"
    )
