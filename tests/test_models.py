import numpy as np
import pytest

from credora.plans.mlp import flatten, init_params, loss_and_grad, unflatten


@pytest.mark.parametrize("double_sigmoid", [False, True])
def test_mlp_gradient_finite_difference(double_sigmoid):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(25, 4))
    y = (rng.random(25) > 0.7).astype(float)
    p = init_params(4, [5, 3], 1)
    _, g = loss_and_grad(p, X, y, 3.0, double_sigmoid)
    v, gv = flatten(p), flatten(g)
    h = 1e-6
    for i in range(0, len(v), 3):
        a, b = v.copy(), v.copy()
        a[i] += h
        b[i] -= h
        num = (loss_and_grad(unflatten(a, p), X, y, 3.0, double_sigmoid)[0]
               - loss_and_grad(unflatten(b, p), X, y, 3.0, double_sigmoid)[0]) / (2 * h)
        assert num == pytest.approx(gv[i], abs=1e-6)


def test_mlp_loss_falls(spark, loans_small):
    from pyspark.sql import functions as F

    from credora.operators import scale
    from credora.plans.mlp import mlp_train

    cols = ["loan_percent_income", "loan_int_rate", "cb_person_cred_hist_length"]
    sc = scale.fit_robust(loans_small, cols)
    m = mlp_train(sc.transform(loans_small), cols, epochs=6, batch_size=64, lr=1e-2)
    losses = [h[1] for h in m.history]
    assert losses[-1] < losses[0]
    scored = m.score(loans_small, keep=["id"])
    assert scored.where(F.col("score").between(0, 1)).count() == loans_small.count()


def test_system_round_trip(spark, loans_small):
    from credora.plans.system import CreditSystem
    from credora.session import scratch_path

    s = CreditSystem(model_params={"maxIter": 3}, use_smote=True)
    rep = s.train(loans_small)
    assert rep["roc_auc"].first()["auc"] > 0.5
    path = scratch_path(spark, "sys-test")
    s.save(path)
    t = CreditSystem.load(path)
    a = s.predict(loans_small.drop("loan_status"))
    b = t.predict(loans_small.drop("loan_status"))
    assert a.count() == loans_small.count() and a.exceptAll(b).count() == 0


def test_parallel_folds_equal_sequential(spark, loans_small):
    from credora.plans import boosted
    from credora.plans.system import CreditSystem

    s = CreditSystem()
    prep = s.prepare(loans_small, fit=True).checkpoint()
    make = lambda: boosted.gbt_estimator("loan_status", "a", maxIter=2)
    seq = boosted.cross_val_auc(prep, s.feature_cols, make, k=3, max_parallel=1).collect()
    par = boosted.cross_val_auc(prep, s.feature_cols, make, k=3).collect()
    assert [tuple(r) for r in seq] == [tuple(r) for r in par]


def test_fits_get_a_part_for_each_core(spark, loans_small):
    from credora.plans import boosted

    cols = ["loan_percent_income", "loan_int_rate"]
    many = loans_small.repartition(23)
    rows = boosted.assembled(many, cols, ["loan_status"], [boosted.gbt_estimator()])
    assert rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert rows.count() == many.count()
    assert [boosted.n_parts(n, 12) for n in (0, 5, 12_000_000, 12_000_001, 42_000_000)] == [12, 12, 12, 24, 48]


def test_meta_model_reads_written_scores(loans_small, monkeypatch):
    from credora.plans import boosted, stack

    fitted, fit = [], stack.fit_pipeline
    monkeypatch.setattr(stack, "fit_pipeline", lambda df, *a: fitted.append(df.columns) or fit(df, *a))
    few = lambda: boosted.gbt_estimator("loan_status", "a", maxIter=1, maxDepth=2)
    stack.stack_fit(loans_small, ["loan_percent_income", "loan_int_rate"], learners={"one": few}, meta_factory=few, k=2)
    assert all("features" in columns for columns in fitted)


def test_assembled_rows_fit_and_score_alike(loans_small):
    from credora.plans import boosted

    cols = ["loan_percent_income", "loan_int_rate", "cb_person_cred_hist_length"]
    make = lambda: boosted.gbt_estimator("loan_status", "subsampled", maxIter=3)
    rows = boosted.assembled(loans_small.select("id", *cols, "loan_status"), cols, ["id"], [make()])
    assert rows.columns == ["id", "loan_status", "features"]
    plain, ready = (boosted.fit_pipeline(df, cols, make()) for df in (loans_small, rows))
    a, b = boosted.predict(plain, loans_small, keep=["id"]), boosted.predict(ready, rows, keep=["id"])
    assert a.count() == loans_small.count() and a.exceptAll(b).count() == 0
    assert boosted.predict(ready, loans_small, keep=["id"]).exceptAll(b).count() == 0
