"""Column helpers that keep IEEE-754 results under ANSI mode (S3, S4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ieee_divide(a, b) -> Column:
    """``a / b`` with IEEE semantics: x/0 -> +-inf, 0/0 -> NaN; NULL stays NULL."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return (F.when(b != 0, a / b)
            .when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
            .when(a.isNaN() | (a == 0), F.lit(float("nan")))
            .when(a > 0, F.lit(float("inf")))
            .otherwise(F.lit(float("-inf"))))


def ieee_log1p(x) -> Column:
    """``log1p`` with -1 -> -inf and below -1 -> NaN (Spark gives NULL)."""
    x = _c(x).cast("double")
    return (F.when(x > -1, F.log1p(x))
            .when(x == -1, F.lit(float("-inf")))
            .when(x.isNull(), F.lit(None).cast("double"))
            .otherwise(F.lit(float("nan"))))


def ieee_sqrt(x) -> Column:
    """``sqrt`` (Spark already yields NaN below zero; kept for symmetry)."""
    return F.sqrt(_c(x).cast("double"))


def sigmoid(z, clip: float = 500.0) -> Column:
    """Logistic function with the exponent clipped to avoid overflow."""
    z = F.greatest(F.least(_c(z).cast("double"), F.lit(clip)), F.lit(-clip))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (cross-engine comparison of floating sums)."""
    return df.select(*[
        F.round(F.col(f.name), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])
