"""Principal components from distributed co-moments.

Means and covariances of the complete rows come from one Gram matrix of mean-shifted
values (``gram``); the d x d eigen problem is solved on the driver (d = number of
features); projection is a broadcast of d x k literals inside one ``select``.
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

from credora.operators.gram import CONSTANT, gram, summed


@dataclass
class PCAModel:
    cols: list[str]
    mean: list[float]
    scale: list[float]
    components: np.ndarray          # k x d, rows are unit loadings
    explained_variance_ratio: list[float]

    def transform(self, df: DataFrame, k: int | None = None, prefix: str = "PC",
                  keep: list[str] | None = None) -> DataFrame:
        k = k or len(self.components)
        z = [(F.col(f"`{c}`").cast("double") - F.lit(m)) / F.lit(s)
             for c, m, s in zip(self.cols, self.mean, self.scale)]
        pcs = [sum((F.lit(float(w)) * zi for w, zi in zip(self.components[j], z)), F.lit(0.0))
               .alias(f"{prefix}{j + 1}") for j in range(k)]
        return df.select(*[F.col(f"`{c}`") for c in (keep or [])], *pcs)

    def n_for_variance(self, target: float) -> int:
        """Smallest k whose cumulative ratio exceeds ``target``."""
        cum = np.cumsum(self.explained_variance_ratio)
        return int(min(len(cum), np.searchsorted(cum, target, side="right") + 1))


def _signed(vecs: np.ndarray) -> np.ndarray:
    """Components with a deterministic sign: the first of the largest-magnitude loadings is positive
    (magnitudes that differ only by rounding count as equal)."""
    for j in range(len(vecs)):
        size = np.abs(vecs[j])
        if vecs[j][np.argmax(size >= size.max() - 1e-9)] < 0:
            vecs[j] = -vecs[j]
    return vecs


def fit_pca(df: DataFrame, cols: list[str], standardize: bool = True) -> PCAModel:
    """Fit on complete rows of ``cols``. ``standardize``: z-score with population std
    first (PCA of the correlation matrix); otherwise centre only."""
    found = gram(df, cols, complete=True)
    cov, mean = found.covariance(), [float(m) for m in found.means()]
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    scale = [float(s) if (standardize and s > 0) else 1.0 for s in sd]
    mat = cov / np.outer(scale, scale)
    vals, vecs = np.linalg.eigh(mat)
    order = np.argsort(vals)[::-1]
    vals, vecs = np.clip(vals[order], 0, None), vecs[:, order].T
    vecs = _signed(vecs)
    total = vals.sum()
    ratio = [float(v / total) if total > 0 else 0.0 for v in vals]
    return PCAModel(list(cols), mean, scale, vecs, ratio)


def fit_pca_wide(df: DataFrame, cols: list[str] | str, k: int = 10, extra: int = 10, turns: int = 6,
                 standardize: bool = True, seed: int = 42) -> PCAModel:
    """The leading ``k`` components of a table of many columns (wide one-hot tables) by a randomised range
    finder: a random d x (k + extra) basis is multiplied by the covariance matrix ``turns`` times, one
    pass over the rows each, and orthonormalised in between; the small problem inside its range is solved on
    the driver. Nothing of size d x d exists anywhere. Exact where k + extra reaches the number of
    columns, else as good as the gap between the spectrum at k and at k + extra allows. Ratios are shares
    of the whole variance. ``cols``: columns, or the name of one array column (thousands of features);
    rows with a NULL are left out."""
    if isinstance(cols, str):
        values, first = F.col(f"`{cols}`").cast("array<double>"), df.select(F.size(f"`{cols}`")).first()
        cols = [f"{cols}[{i}]" for i in range(first[0] if first else 0)]
    else:
        values = F.array(*[F.col(f"`{c}`").cast("double") for c in cols])
    d, width = len(cols), min(k + extra, len(cols))
    rows = df.select(values.alias("x")).where(F.forall("x", lambda v: v.isNotNull())).checkpoint()
    n = rows.count()
    stats = rows.select(array_to_vector("x").alias("v")).agg(
        Summarizer.metrics("mean", "variance").summary(F.col("v")).alias("s")).first()["s"] if n else None
    mean = stats["mean"].toArray() if n else np.zeros(d)
    var = stats["variance"].toArray() * (n - 1) / n if n else np.zeros(d)
    sd = np.sqrt(np.where(var > CONSTANT * (var + mean ** 2), var, 0.0))
    scale = np.where(sd > 0, sd, 1.0) if standardize else np.ones(d)
    total = float(((sd / scale) ** 2).sum())

    def times_covariance(basis: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((d, basis.shape[1]))
            for batch in batches:
                flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                for i in range(0, len(flat), 512):
                    x = np.where(sd > 0, (flat[i:i + 512] - mean) / scale, 0.0)
                    out += x.T @ (x @ basis)
            for i in range(0, d, 1024):
                part = out[i:i + 1024]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part))), pa.array(part.tolist())],
                                                 names=["row", "v"])

        found = summed(rows.mapInArrow(run, "row long, v array<double>"))
        return np.stack([found.get(i, np.zeros(basis.shape[1])) for i in range(d)]) / max(n, 1)

    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    for _ in range(turns if width < d else 0):
        basis = np.linalg.qr(times_covariance(basis))[0]
    inside = basis.T @ times_covariance(basis)
    vals, vecs = np.linalg.eigh((inside + inside.T) / 2)
    order = np.argsort(vals)[::-1][:k]
    components = _signed((basis @ vecs[:, order]).T)
    ratio = [float(max(v, 0) / total) if total > 0 else 0.0 for v in vals[order]]
    return PCAModel(list(cols), mean.tolist(), scale.tolist(), components, ratio)


def pca_variance(df: DataFrame, cols: list[str], standardize: bool = True) -> DataFrame:
    """(component, variance_ratio, cumulative) for every component."""
    m = fit_pca(df, cols, standardize)
    cum = np.cumsum(m.explained_variance_ratio)
    rows = [(j + 1, r, float(c)) for j, (r, c) in enumerate(zip(m.explained_variance_ratio, cum))]
    return df.sparkSession.createDataFrame(rows, "component int, variance_ratio double, cumulative double")


def pca_project(df: DataFrame, cols: list[str], k: int = 2, keep: list[str] | None = None,
                standardize: bool = True) -> DataFrame:
    """Rows in component space (first k), with ``keep`` columns (e.g. id, label)."""
    return fit_pca(df, cols, standardize).transform(df, k, keep=keep)


def pca_keep_variance(train: DataFrame, cols: list[str], target: float = 0.95,
                      others: list[DataFrame] | None = None, keep: list[str] | None = None,
                      standardize: bool = False):
    """Fit on ``train``, keep the fewest components explaining more than ``target``,
    apply to train and every other frame. Returns (frames, model, k)."""
    m = fit_pca(train, cols, standardize)
    k = m.n_for_variance(target)
    frames = [m.transform(f, k, keep=keep) for f in [train] + list(others or [])]
    return frames, m, k
