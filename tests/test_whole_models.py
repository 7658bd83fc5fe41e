"""Registered model queries fit the reference's whole presets: nothing is fitted here, only what would be."""

import pytest

from credora.plans import boosted, queries


class Asked(Exception):
    pass


@pytest.fixture
def asked(monkeypatch):
    """Frames without rows; the fits named by a test end with what they were asked for."""
    monkeypatch.setattr(queries, "_model_frames", lambda spark, sf: (None, None, ["x"]))
    monkeypatch.setattr(queries, "_once", lambda spark, sf, name, make: make())
    monkeypatch.setattr(queries, "loans", lambda spark, sf: None)

    def stop(*args, **kwargs):
        raise Asked(args, kwargs)
    return stop


def sizes(learners):
    made = {n: make() for n, make in learners.items()}
    return {n: e.getNumTrees() if n == "forest" else e.getMaxIter() for n, e in made.items()}


def test_oof_scores_fits_whole_learners(spark, monkeypatch, asked):
    monkeypatch.setattr(queries.stack_plan, "oof_scores", asked)
    with pytest.raises(Asked) as e:
        queries.q_oof_scores(spark, "")
    args, kwargs = e.value.args
    assert sizes(args[2]) == {"gbt": 400, "gbt6": 400, "forest": 100} and kwargs["k"] == 5


def test_stack_fits_whole_learners(spark, monkeypatch, asked):
    monkeypatch.setattr(queries.stack_plan, "stack_fit", asked)
    for query in (queries.q_stack_fit, queries.q_stack_predict):
        with pytest.raises(Asked) as e:
            query(spark, "")
        args, kwargs = e.value.args
        assert sizes(args[3]) == {"gbt": 400, "gbt6": 400, "forest": 100} and kwargs["k"] == 5
        assert args[4]().getMaxIter() == boosted.PRESETS["meta"]["maxIter"] == 400


def test_system_predict_fits_all_trees(spark, monkeypatch, asked):
    monkeypatch.setattr(queries.CreditSystem, "train", asked)
    with pytest.raises(Asked) as e:
        queries.q_system_predict(spark, "")
    system = e.value.args[0][0]
    est = boosted.gbt_estimator(system.label, system.preset, system.seed, **system.model_params)
    assert system.best_prefix and est.getMaxIter() == 900
