"""Pairwise products of many columns in one pass: masked Gram matrices.

Arrow batches of the columns give X'X, X'M, (X^2)'M and M'M with BLAS, where M marks the values that are not
NULL and X is shifted by the columns' means. A task keeps one block of each for all its batches; Spark sums
the blocks row by row. From the four matrices come pairwise-complete moments of every pair, so the plan does
not grow with the number of columns. The driver holds d x d results (d: columns).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONSTANT = 1e-12  # a variance below this share of the second moment is rounding: the column is constant


@dataclass
class Gram:
    """For columns i, j over the rows where both are given: n, sum x_i, sum x_i^2 and sum x_i x_j of the
    values less ``shift``."""
    shift: np.ndarray
    n: np.ndarray
    sum_x: np.ndarray
    sum_xx: np.ndarray
    sum_xy: np.ndarray

    def covariance(self) -> np.ndarray:
        """Population covariances; 0 for constant columns and without common rows."""
        with np.errstate(invalid="ignore", divide="ignore"):
            out = np.nan_to_num((self.sum_xy - self.sum_x * self.sum_x.T / self.n) / self.n)
        constant = np.diag(self._spread()) == 0
        out[constant], out[:, constant] = 0.0, 0.0
        return out

    def _spread(self) -> np.ndarray:
        """n times the sum of squared deviations of x_i on the rows common with x_j; 0 if constant there."""
        spread = self.n * self.sum_xx - self.sum_x ** 2
        return np.where(spread <= CONSTANT * self.n * self.sum_xx, 0.0, spread)

    def correlation(self) -> np.ndarray:
        """Pearson r; NaN where one side is constant on the common rows or there are none."""
        with np.errstate(invalid="ignore", divide="ignore"):
            spread = self._spread()
            r = (self.n * self.sum_xy - self.sum_x * self.sum_x.T) / np.sqrt(spread * spread.T)
        r = np.where(spread * spread.T == 0, np.nan, np.clip(r, -1, 1))
        diagonal = np.diag(r).copy()
        np.fill_diagonal(r, np.where(np.isnan(diagonal), np.nan, 1.0))
        return r

    def means(self) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.shift + np.diag(self.sum_x) / np.diag(self.n)


def _matrix(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Values with 0 for NULL, and the marks of the values."""
    flat = batch.column("x").flatten()
    given = np.ones(len(flat), bool) if flat.null_count == 0 else ~flat.is_null().to_numpy(zero_copy_only=False)
    values = flat.to_numpy(zero_copy_only=False).reshape(-1, d)
    given = given.reshape(-1, d)
    return np.where(given, values, 0.0), given


def summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """(row, v array<double>) summed by row."""
    out = parts.select("row", array_to_vector("v").alias("v")).groupBy("row").agg(
        Summarizer.sum(F.col("v")).alias("v"))
    return {r["row"]: r["v"].toArray() for r in out.collect()}


def gram(df: DataFrame, cols: list[str], complete: bool = False) -> Gram:
    """The matrices of ``cols``. ``complete``: only of rows without any NULL."""
    d = len(cols)
    rows = df.select(F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("x"))
    if complete:
        rows = rows.where(F.forall("x", lambda v: v.isNotNull()))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * d)
        for batch in batches:
            x, given = _matrix(batch, d)
            total += np.r_[x.sum(0), given.sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([total.tolist()])], names=["row", "v"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, 4 * d))
        for batch in batches:
            x, given = _matrix(batch, d)
            m = given.astype(float)
            x = (x - shift) * m
            total += np.hstack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        for i in range(0, d, 64):
            part = total[i:i + 64]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part))), pa.array(part.tolist())],
                                             names=["row", "v"])

    schema = "row long, v array<double>"
    first = summed(rows.mapInArrow(sums, schema)).get(0, np.zeros(2 * d))
    shift = np.nan_to_num(np.divide(first[:d], first[d:], out=np.zeros(d), where=first[d:] > 0))
    found = summed(rows.mapInArrow(blocks, schema))
    total = np.stack([found.get(i, np.zeros(4 * d)) for i in range(d)]).reshape(d, 4, d)
    return Gram(shift, *(total[:, k] for k in range(4)))
