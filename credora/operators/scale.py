"""Robust and standard scaling: fitted statistics applied as literals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credora.operators.quantile import wide_quantiles


@dataclass
class Scaler:
    center: dict[str, float]
    scale: dict[str, float]

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """(x - center) / scale for the fitted columns; other columns pass through."""
        scaled = {c: ((F.col(f"`{c}`").cast("double") - F.lit(self.center[c])) / F.lit(self.scale[c]))
                  for c in self.center}
        if suffix:
            return df.select("*", *[v.alias(f"{c}{suffix}") for c, v in scaled.items()])
        return df.select(*[scaled[c].alias(c) if c in scaled else F.col(f"`{c}`")
                           for c in df.columns])

    def to_dict(self) -> dict:
        return {"center": self.center, "scale": self.scale}


def fit_robust(df: DataFrame, cols: list[str], q_low: float = 0.25, q_high: float = 0.75
               ) -> Scaler:
    """Median and inter-quartile range (exact, linear); an IQR of 0 becomes 1 (S1)."""
    q = wide_quantiles(df, cols, [q_low, 0.5, q_high])
    center = {c: q[(c, 0.5)] for c in cols}
    scale = {}
    for c in cols:
        iqr = q[(c, q_high)] - q[(c, q_low)]
        scale[c] = iqr if iqr != 0 else 1.0
    return Scaler(center, scale)


def fit_standard(df: DataFrame, cols: list[str]) -> Scaler:
    """Mean and population standard deviation in one pass; 0 becomes 1 (S6)."""
    row = df.agg(*[F.avg(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    center = {c: row[f"m{i}"] for i, c in enumerate(cols)}
    scale = {c: (row[f"s{i}"] if row[f"s{i}"] else 1.0) for i, c in enumerate(cols)}
    return Scaler(center, scale)


def robust_scale(train: DataFrame, cols: list[str], other: DataFrame | None = None):
    """Fit on ``train``; return the scaled train (and ``other``) plus the scaler."""
    sc = fit_robust(train, cols)
    return (sc.transform(train), sc.transform(other) if other is not None else None, sc)


def standard_scale(train: DataFrame, cols: list[str], other: DataFrame | None = None):
    sc = fit_standard(train, cols)
    return (sc.transform(train), sc.transform(other) if other is not None else None, sc)
