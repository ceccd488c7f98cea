"""Shared helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Word characters of the contracts: anything but space and TAB..CR.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, UPPER, UPPER.lower())


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """``docs`` with each row as one struct ``_row`` beside ``keys``, so that no column of theirs can clash."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), *[v.alias(k) for k, v in keys.items()])


def dense_names(rows: DataFrame, cols: list[str], bucket: Column, name: str) -> DataFrame:
    """Number distinct ``rows`` 1..n in the order of (bucket, cols).

    Two levels, so no task sees all rows: counts per bucket become offsets (one
    row per bucket; ``bucket`` must take a bounded number of values) and a
    window numbers the rows inside each bucket. The number depends on the rows
    alone, so a recomputed partition gets the same names.
    """
    b = rows.withColumn("_b", bucket)
    sizes = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(*cols))
    return b.withColumn("_r", inside).join(F.broadcast(offsets), "_b").withColumn(name, F.col("_o") + F.col("_r")).drop("_b", "_r", "_o")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long); (id, component_id).

    Each round every node points to the neighbour (itself included) of least
    hash, edges are contracted along those pointers and what became a loop goes.
    A hashed order makes the number of nodes fall by a constant factor a round
    whatever the shape, so rounds grow with the logarithm. component_id is the
    smallest id of the component. Nodes without an edge are not returned.
    A hub of any degree is a counter per partition in the partial ``min_by``;
    its rows in the two joins are split by the skew rule of adaptive execution.
    """
    e = cut_lineage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    at = None
    while not e.isEmpty():
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("v")).agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("id"))).alias("m"))
        own = F.struct(F.xxhash64("v").alias("h"), F.col("v").alias("id"))
        step = cut_lineage(near.select("v", F.least("m", own)["id"].alias("to")))
        if at is None:
            at = step.select(F.col("v").alias("id"), F.col("to").alias("at"))
        else:
            moved = at.join(step, at["at"] == step["v"], "left")
            at = moved.select("id", F.coalesce("to", "at").alias("at"))
        at = cut_lineage(at)
        pa, pb = step.select(F.col("v").alias("a"), F.col("to").alias("ta")), step.select(F.col("v").alias("b"), F.col("to").alias("tb"))
        e = e.join(pa, "a").join(pb, "b").where("ta <> tb")
        e = cut_lineage(e.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    if at is None:
        return e.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    least = at.groupBy("at").agg(F.min("id").alias("component_id"))
    return at.join(least, "at").select("id", "component_id")
