"""Leaf refit, staged scores and the best prefix against NumPy on the same trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from credora.plans import boosted, leaves
from credora.session import scratch_path

COLS = ["loan_percent_income", "loan_int_rate", "cb_person_cred_hist_length"]


@pytest.fixture(scope="module")
def frames(loans_small):
    df = loans_small.select("id", "loan_status", *[F.col(c).cast("double") for c in COLS]).checkpoint()
    valid = F.pmod(F.xxhash64("id"), F.lit(3)) == 0
    return df.where(~valid), df.where(valid)


@pytest.fixture(scope="module")
def fitted(frames):
    return boosted.gbt_classifier(frames[0], COLS, "loan_status", "a", maxIter=9, maxDepth=4)


def matrix(model, df):
    t = leaves.with_leaves(model, df).toPandas().sort_values("id")
    return np.array(t["leaves"].tolist()), t["loan_status"].to_numpy(float)


def auc(y, s):
    wins = (s[y == 1][:, None] > s[y != 1][None, :]).sum() + 0.5 * (s[y == 1][:, None] == s[y != 1][None, :]).sum()
    return wins / ((y == 1).sum() * (y != 1).sum())


def test_own_values_give_the_same_scores(frames, fitted):
    model = leaves.as_fitted(fitted)
    a = {r["id"]: r["score"] for r in boosted.predict(fitted, frames[1], keep=["id"]).collect()}
    b = {r["id"]: r["score"] for r in model.predict(frames[1], keep=["id"]).collect()}
    assert b == pytest.approx(a)


@pytest.mark.parametrize("block", [4, 25])
def test_refit_equals_numpy(frames, fitted, monkeypatch, block):
    monkeypatch.setattr(leaves, "BLOCK", block)
    model = leaves.refit_leaves(fitted, frames[0], l2=2.5, step=0.3)
    at, y = matrix(fitted, frames[0])
    f = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    assert model.base == pytest.approx(f[0])
    losses = []
    for t in range(at.shape[1]):
        p = 1 / (1 + np.exp(-f))
        losses.append(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
        for leaf in np.unique(at[:, t]):
            own = at[:, t] == leaf
            value = -0.3 * (p - y)[own].sum() / ((p * (1 - p))[own].sum() + 2.5)
            assert model.values[t, leaf] == pytest.approx(value, rel=1e-9)
        f += model.values[t, at[:, t]]
    assert losses == sorted(losses, reverse=True)  # every tree lowers the loss
    scores = {r["id"]: r["score"] for r in model.predict(frames[0], keep=["id"]).collect()}
    assert [scores[i] for i in sorted(scores)] == pytest.approx((1 / (1 + np.exp(-f))).tolist())


def test_refit_writes_the_leaves_of_all_trees_once(frames, fitted, monkeypatch):
    written, kind = [], type(frames[0])
    checkpoint = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda df, *a: written.append(dict(df.dtypes)) or checkpoint(df, *a))
    monkeypatch.setattr(leaves, "BLOCK", 2)
    leaves.refit_leaves(fitted, frames[0])
    assert [w["leaves"] for w in written] == ["array<tinyint>"] + ["binary"] * 5


def test_stronger_regularisation_shrinks_leaves(frames, fitted):
    small, large = (leaves.refit_leaves(fitted, frames[0], l2=x).values for x in (0.1, 50.0))
    assert np.abs(large[0]).max() < np.abs(small[0]).max()


def test_best_prefix_equals_sweep(frames, fitted):
    model = leaves.as_fitted(fitted)
    at, y = matrix(fitted, frames[1])
    f = np.cumsum(model.values[np.arange(at.shape[1]), at], axis=1)
    want = [auc(y, f[:, t]) for t in range(at.shape[1])]
    got = {r["n_trees"]: r["auc"] for r in leaves.staged_auc(model, frames[1]).collect()}
    assert [got[t + 1] for t in range(len(want))] == pytest.approx(want)
    best, value = leaves.best_prefix(model, frames[1])
    assert best.n_trees == int(np.argmax(np.array(list(map(lambda t: got[t + 1], range(len(want))))))) + 1
    assert value == pytest.approx(max(want))
    scores = {r["id"]: r["score"] for r in best.predict(frames[1], keep=["id"]).collect()}
    assert [scores[i] for i in sorted(scores)] == pytest.approx((1 / (1 + np.exp(-f[:, best.n_trees - 1]))).tolist())


def test_one_class_and_no_rows(frames, fitted):
    model = leaves.as_fitted(fitted)
    alone, value = leaves.best_prefix(model, frames[1].where("loan_status = 1"))
    assert value is None and alone.n_trees == model.n_trees
    assert leaves.staged_auc(model, frames[1].limit(0)).count() == 0


def test_save_load(spark, frames, fitted):
    model = leaves.refit_leaves(fitted, frames[0])
    path = scratch_path(spark, "leaf-model")
    again = leaves.LeafModel.load(path, model.save(path))
    a, b = model.predict(frames[1], keep=["id"]), again.predict(frames[1], keep=["id"])
    assert a.exceptAll(b).count() == 0 and a.count() == frames[1].count()


def test_early_stop_and_system(spark, frames, loans_small):
    from credora.plans.system import CreditSystem

    model = boosted.early_stop_fit(frames[0], COLS, maxIter=6, maxDepth=3)
    assert 1 <= model.n_trees <= 6
    assert boosted.predict(model, frames[1], keep=["id"]).count() == frames[1].count()
    s = CreditSystem(variant="full", preset="b", balanced_weights=True, best_prefix=True, model_params={"maxIter": 4})
    assert s.train(loans_small)["roc_auc"].first()["auc"] > 0.5
    path = scratch_path(spark, "prefix-system")
    s.save(path)
    a, b = (x.predict(loans_small.drop("loan_status")) for x in (s, CreditSystem.load(path)))
    assert a.exceptAll(b).count() == 0 and a.count() == loans_small.count()
