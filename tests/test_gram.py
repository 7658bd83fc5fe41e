"""Gram matrices against NumPy, and wide tables."""

import time

import numpy as np
import pandas as pd
import pytest

from credora.operators import pca, stats
from credora.operators.gram import gram


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6)) * [1, 1e3, 1e-3, 1, 1, 1] + [0, 1e6, 5, 1, 0, 7]
    x[:, 4] = x[:, 0] * 2 + 3
    x[:, 5] = 0.1  # constant, and not exact in binary
    out = pd.DataFrame(x, columns=list("abcdef"))
    gaps = pd.DataFrame(rng.random((400, 6)) < 0.2, columns=out.columns)
    return out.mask(gaps)


@pytest.fixture(scope="module")
def df(spark, table):
    return spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in table.to_numpy()],
                                 "a double, b double, c double, d double, e double, f double").repartition(3)


def test_pairwise_complete_correlations(df, table):
    got = {(r["col_a"], r["col_b"]): r["r"] for r in stats.corr_matrix(df, list("abcdef")).collect()}
    want = table.corr()
    assert len(got) == 36
    for (a, b), r in got.items():
        if "f" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], rel=1e-9, abs=1e-12)
    assert got["a", "a"] == 1.0 and got["a", "e"] == pytest.approx(1.0)
    assert [(r["col_a"], r["col_b"]) for r in stats.high_corr_pairs(df, list("abcdef"), 0.9).collect()] == [("a", "e")]


def test_complete_rows_covariance(df, table):
    full = table.dropna()
    g = gram(df, list("abcdef"), complete=True)
    assert g.n[0, 0] == len(full)
    assert g.means() == pytest.approx(full.mean().to_numpy())
    want = np.cov(full.to_numpy().T, bias=True)
    want[5], want[:, 5] = 0, 0
    assert g.covariance() == pytest.approx(want, rel=1e-7, abs=1e-12)


def test_vif_equals_inverse(df, table):
    got = {r["feature"]: r["vif"] for r in stats.vif(df, list("abcd")).collect()}
    inverse = np.linalg.inv(table[list("abcd")].corr().to_numpy())
    assert [got[c] for c in "abcd"] == pytest.approx(np.diag(inverse).tolist())


def test_no_rows_and_no_common_rows(spark, df):
    assert all(r["r"] is None for r in stats.corr_matrix(df.limit(0), ["a", "b"]).collect())
    apart = spark.createDataFrame([(1.0, None), (2.0, None), (None, 1.0), (None, 3.0)], "a double, b double")
    got = {(r["col_a"], r["col_b"]): r["r"] for r in stats.corr_matrix(apart, ["a", "b"]).collect()}
    assert got["a", "b"] is None and got["a", "a"] == 1.0


def test_five_hundred_columns(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 500))
    cols = [f"c{i}" for i in range(500)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols)).checkpoint()
    began = time.time()
    r = gram(df, cols).correlation()
    model = pca.fit_pca(df, cols)
    assert time.time() - began < 60
    assert r == pytest.approx(np.corrcoef(x.T), abs=1e-9)
    assert sum(model.explained_variance_ratio) == pytest.approx(1.0)


def test_wide_components_equal_exact(spark):
    """A few strong directions in 60 columns, one of them constant, and 7 columns at full width."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 60)) * 0.2 + rng.normal(size=(500, 4)) @ rng.normal(size=(4, 60))
    x[:, 9] = 0.1
    cols = [f"c{i}" for i in range(60)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols)).checkpoint()
    for some, k in ((cols, 4), (cols[:7], 7)):
        exact, found = pca.fit_pca(df, some), pca.fit_pca_wide(df, some, k)
        assert found.explained_variance_ratio == pytest.approx(exact.explained_variance_ratio[:k], abs=1e-6)
        assert np.abs(found.components) == pytest.approx(np.abs(exact.components[:k]), abs=1e-4)
    assert pca.fit_pca_wide(df.limit(0), cols[:3], 2).explained_variance_ratio == [0.0, 0.0]


def test_five_thousand_columns(spark):
    rng = np.random.default_rng(7)
    x = (rng.random((300, 5000)) < 0.02).astype(float) + np.outer(rng.normal(size=300), rng.normal(size=5000))
    wide = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    model = pca.fit_pca_wide(wide, "v", k=1, turns=4)
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    want = np.linalg.svd(z, compute_uv=False)[0] ** 2 / (z ** 2).sum()
    assert model.explained_variance_ratio[0] == pytest.approx(want, abs=1e-6)
