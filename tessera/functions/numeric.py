"""Numeric column expressions: NaN handling, logit/log transforms and inverses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_double(col: Column | str) -> Column:
    """Cast to double and turn NaN into NULL (Spark orders NaN above every number)."""
    c = _c(col).cast("double")
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def logit(col: Column | str, eps: float) -> Column:
    """ln(p / (1 - p)) after clipping p to [eps, 1 - eps]."""
    p = F.least(F.greatest(_c(col), F.lit(eps)), F.lit(1.0 - eps))
    return F.ln(p / (F.lit(1.0) - p))


def sigmoid(col: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(col)))


def round6(col: Column | str) -> Column:
    """Round to 6 decimals and fold -0.0 into 0.0 (stable value hashes)."""
    return F.round(_c(col), 6) + F.lit(0.0)
