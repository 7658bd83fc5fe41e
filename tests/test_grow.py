"""Trees grown from binned blocks against Spark's own fit of the same estimator."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from credora.plans import boosted, grow

COLS = ["a", "b", "c", "d", "flag", "kind", "still"]


def made(spark, n=3000):
    u = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(9973)) / 9973.0
    df = spark.range(n, numPartitions=2).select(
        "id", u(1).alias("a"), (u(2) * u(3)).alias("b"), F.floor(u(4) * 12).cast("double").alias("c"),
        F.when(u(5) < 0.4, 0.0).otherwise(u(6) - 0.5).alias("d"), (u(7) < 0.3).cast("double").alias("flag"),
        F.floor(u(8) * 5).cast("double").alias("kind"), F.lit(1.5).alias("still"), u(9).alias("_n"))
    chance = F.col("a") * 0.5 + F.col("flag") * 0.3 + F.when(F.col("c") > 7, 0.2).otherwise(0.0) + F.col("d") * 0.2
    return df.withColumn("loan_status", (chance > F.col("_n")).cast("bigint")) \
        .withColumn("w", F.when(F.col("loan_status") == 1, 2.5).otherwise(0.75)).drop("_n")


def assembled(spark, est):
    return boosted.assembled(made(spark), COLS, ["id", "loan_status"], [est])


def scores(model, rows):
    out = model.transform(rows).orderBy("id").select(vector_to_array("probability")[1]).collect()
    return np.array([r[0] for r in out])


@pytest.mark.parametrize("weight_col, local", [(None, 10**6), ("w", 10**6), ("w", 100)])
def test_grown_trees_are_sparks(spark, monkeypatch, weight_col, local):
    monkeypatch.setattr(grow, "LOCAL_ROWS", local)
    monkeypatch.setattr(grow, "BLOCK_ROWS", 700)
    est = boosted.gbt_estimator("loan_status", "b", weight_col=weight_col, maxIter=20, maxDepth=3)
    rows = assembled(spark, est)
    assert grow.can_grow(est, rows)
    want, got = est.fit(rows), grow.grow(est, rows)
    assert got.getNumTrees == 20 and got.treeWeights == want.treeWeights and got.uid == want.uid
    # tied splits part the fitted rows alike, so scores agree whichever of them is taken
    assert scores(got, rows) == pytest.approx(scores(want, rows), abs=1e-9)
    assert [t.depth for t in got.trees] == [t.depth for t in want.trees]
    assert got.featureImportances.toArray().sum() == pytest.approx(1.0)


def test_fit_runs_few_jobs(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(grow, "SMALL_ROWS", 100)
    est = boosted.gbt_estimator("loan_status", "a", maxIter=30, maxDepth=4)
    rows = assembled(spark, est)
    sc = spark.sparkContext
    sc.setJobGroup("grown", "a fit")
    try:
        model = boosted.fit_pipeline(rows, COLS, est)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert model.stages[-1].getNumTrees == 30
    assert 0 < len(sc.statusTracker().getJobIdsForGroup("grown")) < 30
    model.write().overwrite().save(str(tmp_path / "m"))
    again = type(model).load(str(tmp_path / "m"))
    assert (scores(again.stages[-1], rows) == scores(model.stages[-1], rows)).all()


def test_one_class_and_pure_nodes(spark):
    est = boosted.gbt_estimator("loan_status", "a", maxIter=20, maxDepth=3)
    for label in (F.lit(1), (F.col("flag") == 1).cast("int")):
        rows = boosted.assembled(made(spark, 300).withColumn("loan_status", label), COLS, ["id", "loan_status"], [est])
        want, got = est.fit(rows), grow.grow(est, rows)
        assert scores(got, rows) == pytest.approx(scores(want, rows), abs=1e-9)


def test_other_fits_stay_with_spark(spark, monkeypatch):
    few = boosted.gbt_estimator("loan_status", "a", maxIter=3)
    rows = assembled(spark, few)
    stop = boosted.gbt_estimator("loan_status", "a", validationIndicatorCol="id")
    for est in (few, stop, boosted.gbt_estimator("loan_status", "subsampled"), boosted.forest_estimator("loan_status")):
        assert not grow.can_grow(est, rows)
    able = boosted.gbt_estimator("loan_status", "b")
    assert grow.can_grow(able, rows)
    monkeypatch.setattr(grow, "grow", lambda est, df: "grown")
    monkeypatch.setattr(type(able), "fit", lambda est, df: "fitted")
    assert grow.fit(able, rows) == "fitted"
    monkeypatch.setattr(grow, "SMALL_ROWS", rows.count() - 1)
    assert (grow.fit(able, rows), grow.fit(few, rows)) == ("grown", "fitted")


def test_bad_rows_raise_as_in_sparks_fit(spark, monkeypatch):
    monkeypatch.setattr(grow, "SMALL_ROWS", 0)
    est = boosted.gbt_estimator("loan_status", "a", maxIter=20)
    for bad in (F.lit(2), F.lit(None).cast("int")):
        rows = made(spark, 60).withColumn("loan_status", bad)
        with pytest.raises(Exception):
            boosted.fit_pipeline(rows, COLS, est)


@pytest.mark.parametrize("bins", [[32, 2, 2, 3, 7, 1, 5], [32, 31, 19, 4, 4, 2], [1], [256, 2]])
def test_codes_hold_every_bin(bins):
    codes = grow.Codes.of(bins)
    rng = np.random.default_rng(0)
    own = [rng.integers(0, b, 200) for b in bins]
    packed = np.zeros((codes.n_groups, 200), np.uint8)
    for f, v in enumerate(own):
        packed[codes.group[f]] += (v * codes.unit[f]).astype(np.uint8)
    for f, v in enumerate(own):
        assert (codes.bin_of(f)[packed[codes.group[f]]] == v).all()
    y = rng.choice([-1, 1], 200)
    sums = grow._sums(iter([((packed, y, None), None)]), codes, None, 0, np.zeros(1, np.intp), 1)
    for f, v in enumerate(own):
        assert sums[1, 0, f, :bins[f]] == pytest.approx(np.bincount(v, y, bins[f]))
        assert (sums[3, 0, f, :bins[f]] == np.bincount(v, minlength=bins[f])).all()
