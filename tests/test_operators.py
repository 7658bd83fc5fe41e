import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from credora.operators import encode, features, metrics, profile, sample, scale, stats


def test_corr_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 2.0)], "a double, b double")
    m = {(r["col_a"], r["col_b"]): r["r"] for r in stats.corr_matrix(df, ["a", "b"]).collect()}
    assert m[("a", "b")] is None and m[("b", "b")] is None and m[("a", "a")] == 1.0


def test_robust_scale_zero_iqr_keeps_centered(spark):
    df = spark.createDataFrame([(float(i >= 90),) for i in range(100)], "x double")
    sc = scale.fit_robust(df, ["x"])
    assert sc.scale["x"] == 1.0 and sc.center["x"] == 0.0
    vals = sorted(r["x"] for r in sc.transform(df).collect())
    assert vals[-1] == 1.0 and vals[0] == 0.0


def test_standard_scale_population_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    sc = scale.fit_standard(df, ["x"])
    assert sc.scale["x"] == pytest.approx(np.std([1, 2, 3, 4]))


def test_bin_codes_right_closed(spark):
    df = spark.createDataFrame([(0,), (25,), (26,), (100,), (101,), (None,)], "age int")
    got = [r["g"] for r in features.bin_codes(df, "age", features.AGE_EDGES, "g").collect()]
    assert got == [-1, 0, 1, 3, -1, -1]


def test_one_hot_alignment_and_unseen(spark):
    train = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    test = spark.createDataFrame([("c",), ("z",), (None,)], "k string")
    lv = encode.fit_categories(train, ["k"])
    out = encode.one_hot_drop_first(test, ["k"], lv).collect()
    assert [(r["k_b"], r["k_c"]) for r in out] == [(0, 1), (0, 0), (0, 0)]
    with pytest.raises(Exception):
        encode.label_encode(test, ["k"], lv).collect()
    codes = [r["k_encoded"] for r in encode.label_encode(train, ["k"], lv).collect()]
    assert codes == [0, 1, 2]


def test_flag_null_is_zero_and_median_strict(spark):
    df = spark.createDataFrame([(None,), (5.0,), (4.0,), (7.0,)], "x double")
    assert [r["f"] for r in features.flag_at_least(df, "x", 5, "f").collect()] == [0, 1, 0, 1]
    assert [r["h"] for r in features.flag_above_median(df, "x", "h").collect()] == [0, 0, 0, 1]


def test_binary_scores_zero_division(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 0)], "y int, p int")
    r = metrics.binary_scores(df, "y", "p").first()
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["f1"] == 0.0


def _auc_pairs(y, s):
    pos = [v for v, t in zip(s, y) if t == 1]
    neg = [v for v, t in zip(s, y) if t == 0]
    tot = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_ties_and_negation(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400).tolist()
    s = (np.round(rng.normal(size=400) + np.array(y), 1)).tolist()   # heavy ties
    df = spark.createDataFrame(list(zip(y, s)), "y int, s double")
    auc = metrics.roc_auc(df, "y", "s").first()["auc"]
    assert auc == pytest.approx(_auc_pairs(y, s), abs=1e-12)
    neg = metrics.roc_auc(df.withColumn("s", -F.col("s")), "y", "s").first()["auc"]
    assert neg == pytest.approx(1 - auc, abs=1e-12)
    curve = metrics.roc_curve(df, "y", "s", drop_intermediate=True).collect()
    full = metrics.roc_curve(df, "y", "s").collect()
    assert len(curve) <= len(full)
    pts = sorted((r["fpr"], r["tpr"]) for r in full)
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:]))
    assert area == pytest.approx(auc, abs=1e-9)


def test_mann_whitney_matches_bruteforce(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 300)
    x = np.round(rng.normal(size=300) + 0.3 * y, 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, x)], "y int, x double")
    r = stats.mann_whitney_u(df, ["x"], "y").first()
    g0, g1 = x[y == 0], x[y == 1]
    u0 = sum((a > b) + 0.5 * (a == b) for a in g0 for b in g1)
    assert r["u"] == pytest.approx(u0)
    n0, n1, n = len(g0), len(g1), len(x)
    _, t = np.unique(x, return_counts=True)
    sigma = math.sqrt(n0 * n1 / 12 * ((n + 1) - (t ** 3 - t).sum() / (n * (n - 1))))
    z = (max(u0, n0 * n1 - u0) - n0 * n1 / 2 - 0.5) / sigma
    assert r["p"] == pytest.approx(min(1.0, math.erfc(z / math.sqrt(2))), rel=1e-9)


def test_chi_square_yates_only_for_2x2(spark):
    rows = [("a", 0)] * 30 + [("a", 1)] * 10 + [("b", 0)] * 20 + [("b", 1)] * 20
    df = spark.createDataFrame(rows, "k string, y int")
    r = stats.chi_square(df, ["k"], "y").first()
    o = np.array([[30, 10], [20, 20]], float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    d = np.abs(o - e)
    assert r["chi2"] == pytest.approx((((d - np.minimum(0.5, d)) ** 2) / e).sum())
    assert r["dof"] == 1
    rows3 = rows + [("c", 0)] * 5 + [("c", 1)] * 15
    r3 = stats.chi_square(spark.createDataFrame(rows3, "k string, y int"), ["k"], "y").first()
    o3 = np.array([[30, 10], [20, 20], [5, 15]], float)
    e3 = o3.sum(1, keepdims=True) * o3.sum(0, keepdims=True) / o3.sum()
    assert r3["chi2"] == pytest.approx(((o3 - e3) ** 2 / e3).sum()) and r3["dof"] == 2


def test_split_and_folds_invariants(spark, loans_small):
    base = loans_small.select("id", "loan_status")
    a = sample.stratified_split(base.repartition(1)).collect()
    b = sample.stratified_split(base.repartition(17)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    n = base.count()
    assert len(a) == n and len({r["id"] for r in a}) == n
    folds = sample.stratified_kfold(base).groupBy("loan_status", "fold").count().collect()
    for cls in (0, 1):
        c = [r["count"] for r in folds if r["loan_status"] == cls]
        assert max(c) - min(c) <= 1


def test_shuffle_batches_drop_incomplete(spark, loans_small):
    n = loans_small.count()
    b = sample.shuffle_batches(loans_small.select("id"), 3, 32)
    assert b.count() == (n // 32) * 32
    assert b.groupBy("batch").count().agg(F.min("count"), F.max("count")).first() == (32, 32)


def test_describe_matches_numpy(spark, loans_small):
    pdf = loans_small.select("loan_amnt", "person_emp_length").toPandas()
    d = {r["feature"]: r for r in profile.describe(loans_small, ["loan_amnt", "person_emp_length"]).collect()}
    for c in ("loan_amnt", "person_emp_length"):
        v = pdf[c].dropna().to_numpy()
        assert d[c]["count"] == len(v)
        assert d[c]["std"] == pytest.approx(np.std(v, ddof=1))
        assert d[c]["q25"] == pytest.approx(np.percentile(v, 25))
        assert d[c]["q75"] == pytest.approx(np.percentile(v, 75))


def test_histogram_counts_sum(spark, loans_small):
    h = stats.histogram(loans_small, ["loan_amnt"], 50).collect()
    assert len(h) == 50 and sum(r["count"] for r in h) == loans_small.count()
    v = loans_small.select("loan_amnt").toPandas()["loan_amnt"].to_numpy()
    np_counts, _ = np.histogram(v, bins=50)
    assert [r["count"] for r in sorted(h, key=lambda r: r["bin"])] == np_counts.tolist()


def test_vif_and_pca_match_numpy(spark, loans_small):
    from credora.operators.pca import fit_pca

    cols = ["person_age", "cb_person_cred_hist_length", "loan_int_rate", "loan_amnt"]
    X = loans_small.select(*cols).toPandas().to_numpy()
    R = np.corrcoef(X, rowvar=False)
    v = {r["feature"]: r["vif"] for r in stats.vif(loans_small, cols).collect()}
    for c, e in zip(cols, np.diag(np.linalg.inv(R))):
        assert v[c] == pytest.approx(e, rel=1e-8)
    m = fit_pca(loans_small, cols)
    ev = np.sort(np.linalg.eigvalsh(R))[::-1]
    assert m.explained_variance_ratio == pytest.approx((ev / ev.sum()).tolist(), rel=1e-8)
    assert m.n_for_variance(0.95) >= 1


def test_invariants_partitioning_and_scaling(spark, loans_small):
    """AUC and quantiles do not depend on partitioning; robust scaling centres the median."""
    from credora.sources.loans import scored_loans
    from .conftest import SF001

    s = scored_loans(spark, SF001)
    a1 = metrics.roc_auc(s.repartition(1), "loan_status", "score_a").first()["auc"]
    a17 = metrics.roc_auc(s.repartition(17), "loan_status", "score_a").first()["auc"]
    assert a1 == pytest.approx(a17, abs=1e-15)
    cols = ["loan_int_rate", "loan_amnt"]
    sc = scale.fit_robust(loans_small, cols)
    out = sc.transform(loans_small).toPandas()
    for c in cols:
        assert float(np.median(out[c])) == pytest.approx(0.0, abs=1e-12)
    d1 = profile.describe(loans_small.repartition(1), cols).collect()
    d9 = profile.describe(loans_small.repartition(9), cols).collect()
    key = lambda r: r["feature"]
    for x, y in zip(sorted(d1, key=key), sorted(d9, key=key)):
        assert x["q50"] == y["q50"] and x["count"] == y["count"]
