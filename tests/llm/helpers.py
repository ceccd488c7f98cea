"""Small tables for the corpus operator tests."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
#: Names that operators use inside; as input columns they must do no harm.
CLASHES = ("h", "name", "block", "fp", "score", "size", "sha", "n", "words", "_k", "target", "kept")


def documents(spark, rows, clash=False):
    """rows: (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        for c in CLASHES:
            df = df.withColumn(c, F.lit("x"))
    return df
