"""No operator loses or leaks rows: null classes, heavy values, folds, missing-value tokens."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from credora.operators import encode, metrics, sample
from credora.operators.quantile import exact_quantiles
from credora.session import scratch_path
from credora.sources.tables import NA_TOKENS, read_table


def test_null_labels_stay_in_splits_folds_and_weights(spark):
    rows = [(i, None if i % 10 == 0 else i % 3) for i in range(1000)] + [(None, 1), (None, None)]
    df = spark.createDataFrame(rows, "id long, y int")
    split = sample.stratified_split(df, "y", 0.2)
    assert split.count() == len(rows)
    assert split.where("y IS NULL AND split = 'test'").count() == 20
    folds = sample.stratified_kfold(df, "y", 5)
    assert folds.count() == len(rows)
    sizes = [r["count"] for r in folds.where("y IS NULL").groupBy("fold").count().collect()]
    assert sum(sizes) == 101 and max(sizes) - min(sizes) <= 1
    weighted = sample.with_class_weight(df, "y", "w")
    assert weighted.count() == len(rows) and weighted.where("w IS NULL").count() == 0


@pytest.mark.parametrize("select_rows", [1, 50, 10_000])
def test_quantiles_at_every_rank_around_a_heavy_value(spark, select_rows):
    vals = [-3.0, -2.0, -1.0] + [0.0] * 1001 + [float(i) / 7 for i in range(1, 90)]
    df = spark.createDataFrame([(v,) for v in vals], "v double").repartition(5)
    n = len(vals)
    ranks = [0, 1, 2, 3, 4, 500, 1002, 1003, 1004, 1005, n - 2, n - 1]
    probs = [r / (n - 1) for r in ranks]
    got = {r["p"]: r["q"] for r in exact_quantiles(df, "v", probs, select_rows=select_rows).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.percentile(vals, p * 100)), abs=1e-12)


def test_quantiles_of_null_keys_and_empty_columns(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("b", float("nan")), ("b", 5.0)],
                               "k string, v double")
    got = {(r["k"], r["p"]): r["q"] for r in exact_quantiles(df, "v", [0.5], ["k"]).collect()}
    assert got == {(None, 0.5): 2.0, ("b", 0.5): 5.0}


def test_roc_drops_exactly_the_points_inside_segments(spark):
    rows = [(float(i), 1 if i >= 25 else 0) for i in range(50)]  # one step: up, then right
    df = spark.createDataFrame(rows, "s double, y int")
    kept = metrics.roc_curve(df, "y", "s", drop_intermediate=True).collect()
    assert sorted((r["fpr"], r["tpr"]) for r in kept) == [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)]
    rng = np.random.default_rng(5)
    s, y = np.round(rng.normal(size=400), 1), rng.integers(0, 2, 400)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    cuts = sorted(set(s.tolist()), reverse=True)
    fps = np.array([0] + [int(((s >= c) & (y == 0)).sum()) for c in cuts])
    tps = np.array([0] + [int(((s >= c) & (y == 1)).sum()) for c in cuts])
    keep = np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True]
    want = sorted(zip(fps[keep] / fps[-1], tps[keep] / tps[-1]))
    got = sorted((r["fpr"], r["tpr"]) for r in metrics.roc_curve(df, "y", "s", drop_intermediate=True).collect())
    assert np.allclose(want, got)


def test_curves_of_null_parts(spark):
    df = spark.createDataFrame([(None, 0.1, 0), (None, 0.9, 1), ("m", 0.5, 0), ("m", 0.4, 1)],
                               "model string, s double, y int")
    out = {r["model"]: r["auc"] for r in metrics.roc_auc(df, "y", "s", ["model"]).collect()}
    assert out == {None: 1.0, "m": 0.0}


def test_csv_types_follow_cleaning(spark):
    path = scratch_path(spark, "csv-na")
    rows = [("2.5", "1", "x"), ("NA", "#N/A", "#NA"), ("-1.#IND", "7", "y"), ("1e3", "null", "None")]
    spark.createDataFrame(rows, "a string, b string, c string").coalesce(1).write.option("header", True).csv(path)
    out = read_table(spark, path, fmt="csv")
    assert out.dtypes == [("a", "double"), ("b", "bigint"), ("c", "string")]
    assert [tuple(r) for r in out.collect()] == [(2.5, 1, "x"), (None, None, None), (None, 7, "y"),
                                                 (1000.0, None, None)]
    tokens = scratch_path(spark, "csv-tokens")
    spark.createDataFrame([(i, t) for i, t in enumerate(NA_TOKENS)], "i int, t string") \
        .write.option("header", True).csv(tokens)
    assert read_table(spark, tokens, fmt="csv").where("t IS NOT NULL").count() == 0


def test_label_codes_of_many_levels(spark):
    df = spark.range(5000).select("id", F.concat(F.lit("k"), F.col("id") % 1700).alias("k"),
                                  F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("z"))
    out = encode.label_encode(df, ["k", "z"])
    order = {v: i for i, v in enumerate(sorted(f"k{i}" for i in range(1700)))}
    for r in out.collect():
        assert r["k_encoded"] == order[r["k"]]
        assert r["z_encoded"] == ({"1": 0, "2": 1}.get(r["z"]))
    with pytest.raises(ValueError):
        encode.one_hot_full(df, ["k"])
    assert len(encode.one_hot_full(df, ["k"], max_levels=2000).columns) == 1702


def test_cross_validation_scores_real_rows_only(spark, loans_small, monkeypatch):
    """Synthetic rows are made inside training parts: no negative id reaches a validation fold."""
    from credora.plans import boosted
    from credora.plans.system import CreditSystem

    seen = []
    fit, predict = boosted.fit_pipeline, boosted.predict

    def watched(model, df, *args, **kw):
        seen.append(df.where("id < 0").count() if "id" in df.columns else None)
        return predict(model, df, *args, **kw)

    trained = []

    def watched_fit(df, *args, **kw):
        trained.append(df.where("id < 0").count())
        return fit(df, *args, **kw)

    monkeypatch.setattr(boosted, "predict", watched)
    monkeypatch.setattr(boosted, "fit_pipeline", watched_fit)
    s = CreditSystem(model_params={"maxIter": 2}, use_smote=True)
    rep = s.train(loans_small, cv_folds=3)
    assert rep["cv"].count() == 5
    assert seen and all(n == 0 for n in seen)
    assert len(trained) == 4 and all(n > 0 for n in trained)


def test_stack_system_and_nets_round_trip(spark, loans_small):
    from credora.plans.mlp import MLP, mlp_cross_val, mlp_train
    from credora.plans.system import StackSystem

    s = StackSystem(model_params={"maxIter": 2, "folds": 2})
    rep = s.train(loans_small)
    assert rep["roc_auc"].first()["auc"] > 0.5 and 0 < s.threshold < 1
    path = scratch_path(spark, "stack-test")
    s.save(path)
    loaded = StackSystem.load(path)
    assert loaded.threshold == s.threshold
    rows = loans_small.drop("loan_status")
    a, b = s.predict(rows), loaded.predict(rows)
    assert a.count() == loans_small.count() and a.exceptAll(b).count() == 0

    cols = ["loan_percent_income", "loan_int_rate"]
    net = mlp_train(loans_small, cols, hidden=[3], epochs=2, batch_size=64)
    net.save(spark, scratch_path(spark, "net") + "/net")
    path = scratch_path(spark, "net")
    net.save(spark, path)
    again = MLP.load(spark, path)
    assert again.history == net.history
    assert again.score(loans_small, ["id"]).exceptAll(net.score(loans_small, ["id"])).count() == 0
    table = net.evaluate(loans_small).first()
    assert 0 <= table["accuracy"] <= 1 and not math.isnan(table["auc"])
    cv = mlp_cross_val(loans_small, cols, k=2, hidden=[3], epochs=1, batch_size=64)
    assert [r["fold"] for r in cv.collect()] == ["0", "1", "mean", "spread"]
