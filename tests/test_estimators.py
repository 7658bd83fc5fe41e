"""Binned densities within their bound, neighbour mutual information against a plain version."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from credora.operators import stats
from credora.operators.neighbour_mi import digamma, mutual_info_neighbours


def psi(x):
    out = 0.0
    while x < 30:
        out -= 1 / x
        x += 1
    return out + math.log(x) - 1 / (2 * x) - 1 / (12 * x ** 2) + 1 / (120 * x ** 4) - 1 / (252 * x ** 6)


def plain_mi(values, classes, k):
    sizes = Counter(classes)
    rows = [(v, c) for v, c in zip(values, classes) if sizes[c] > 1]
    near = m = per_class = 0.0
    for i, (v, c) in enumerate(rows):
        gaps = sorted(abs(u - v) for j, (u, e) in enumerate(rows) if e == c and j != i)
        kk = min(k, len(gaps))
        d = gaps[kk - 1]
        near += psi(kk)
        per_class += psi(sizes[c])
        m += psi(sum(v - d < u < v + d if d > 0 else u == v for u, _ in rows))
    return max(0.0, psi(len(rows)) + (near - per_class - m) / len(rows))


@pytest.mark.parametrize("k", [1, 3, 6])
def test_neighbour_mi_equals_plain(spark, k):
    rng = np.random.default_rng(k)
    c = rng.choice(["x", "y", "z"], 300, p=[0.6, 0.37, 0.03]).tolist() + ["single"]
    cont = np.round(rng.normal(size=301) + np.array([{"x": 0, "y": 1.5, "z": 4}.get(v, 9) for v in c]), 6).tolist()
    tied = np.floor(rng.exponential(2, 301)).tolist()  # many ties: distances of 0
    noise = (rng.random(301) * 8).round(2).tolist()
    rows = [(c[i], cont[i], tied[i], noise[i]) for i in range(301)]
    df = spark.createDataFrame(rows + [(None, 1.0, 1.0, 1.0), ("x", None, None, None), ("y", float("nan"), None, None)],
                               "cls string, cont double, tied double, noise double").repartition(3)
    got = {r["feature"]: r["mi"] for r in mutual_info_neighbours(df, ["cont", "tied", "noise"], "cls", k).collect()}
    for name, values in (("cont", cont), ("tied", tied), ("noise", noise)):
        assert got[name] == pytest.approx(plain_mi(values, c, k), abs=1e-9)
    assert got["cont"] > got["noise"]


def test_neighbour_mi_without_rows(spark):
    empty = spark.createDataFrame([], "cls string, v double")
    assert mutual_info_neighbours(empty, ["v"], "cls").count() == 0
    alone = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "cls string, v double")
    assert mutual_info_neighbours(alone, ["v"], "cls").count() == 0


def test_digamma(spark):
    xs = [1, 2, 3, 7, 100, 10 ** 6]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x long").select(digamma(F.col("x"))).collect()]
    assert got == pytest.approx([psi(x) for x in xs], abs=1e-11)


@pytest.mark.parametrize("error", [1e-2, 1e-4])
def test_binned_density_within_its_bound(spark, error):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b)) for a, b in zip(np.r_[rng.normal(size=900), 40.0], np.floor(rng.random(901) * 5))]
    df = spark.createDataFrame(rows, "a double, b double").repartition(3)
    exact = {(r["feature"], r["grid_index"]): r for r in stats.kde(df, ["a", "b"]).collect()}
    found = stats.kde_binned(df, ["a", "b"], error=error).collect()
    assert len(found) == len(exact) == 400
    x = np.array(rows)
    for r in found:
        e = exact[r["feature"], r["grid_index"]]
        v = x[:, "ab".index(r["feature"])]
        peak = 1 / (v.std(ddof=1) * len(v) ** -0.2 * math.sqrt(2 * math.pi))
        assert r["x"] == e["x"] and abs(r["density"] - e["density"]) <= error * peak * 1.0001
