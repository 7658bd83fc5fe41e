"""Boosted-tree classifiers on DataFrames (Spark ML), prediction, importance, CV.

The tree engine is Spark's ``GBTClassifier``: each level of each tree is a distributed
histogram aggregation; on large tables, fits that do not sample rows are grown in NumPy by the same rules (``grow``). Presets carry the reference's settings; Spark has no L2 leaf
term, so ``early_stop_fit`` refits the leaf values with one (``leaves``) and keeps the
prefix of the best validation AUC. Fold loops submit independent
Spark jobs; scoring stays a ``transform``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credora.operators.metrics import roc_auc
from credora.plans import grow, leaves
from credora.session import ensure_checkpoint_dir

# The reference's boosted-tree settings (trees, depth, learning rate).
PRESETS = {
    "a": dict(maxIter=200, maxDepth=7, stepSize=0.05),
    "b": dict(maxIter=900, maxDepth=7, stepSize=0.045, minInstancesPerNode=3),
    "report_a": dict(maxIter=200, maxDepth=7, stepSize=0.05),
    "report_b": dict(maxIter=200, maxDepth=6, stepSize=0.05),
    "subsampled": dict(maxIter=400, maxDepth=7, stepSize=0.05, subsamplingRate=0.8,
                       featureSubsetStrategy="0.8"),
    "subsampled_6": dict(maxIter=400, maxDepth=6, stepSize=0.05, subsamplingRate=0.8,
                         featureSubsetStrategy="0.8"),
    "meta": dict(maxIter=400, maxDepth=5, stepSize=0.05),
}


FEATURES = "features"
ROWS_PER_TASK = 1_000_000  # a fit keeps some 200 MB of binned rows for each part of that size


def gbt_estimator(label: str = "loan_status", preset: str = "a", seed: int = 42,
                  weight_col: str | None = None, features_col: str = "features",
                  **overrides) -> GBTClassifier:
    params = {**PRESETS[preset], **overrides}
    # node ids are not cached: at these depths that costs a pass and checkpoints and saves nothing
    est = GBTClassifier(labelCol=label, featuresCol=features_col, seed=seed,
                        cacheNodeIds=False, checkpointInterval=10, **params)
    if weight_col:
        est = est.setWeightCol(weight_col)
    return est


def forest_estimator(label: str = "loan_status", seed: int = 42, features_col: str = "features",
                     **overrides) -> RandomForestClassifier:
    params = {"numTrees": 100, "maxDepth": 7, **overrides}
    return RandomForestClassifier(labelCol=label, featuresCol=features_col, seed=seed, **params)


def assembler(feature_cols: list[str], features_col: str = FEATURES) -> VectorAssembler:
    return VectorAssembler(inputCols=list(feature_cols), outputCol=features_col, handleInvalid="error")


def assembled(df: DataFrame, feature_cols: list[str], keep: list[str], estimators: list) -> DataFrame:
    """``keep``, all columns that are no features, and the feature vector, written once. A fit reads its rows four times
    before they are binned, and every fold's fit and scoring reads them again: none of them assembles the
    columns anew. ``df`` itself where an estimator names its vector otherwise. The rows come in no more parts than
    tasks run at once (``ROWS_PER_TASK`` rows each at most): a tree is two stages a level, and each starts a task
    for each part."""
    if any(e.getFeaturesCol() != FEATURES for e in estimators) or FEATURES in df.columns:
        return df
    ensure_checkpoint_dir(df.sparkSession)
    weights = [e.getWeightCol() for e in estimators if e.hasParam("weightCol") and e.isDefined("weightCol")]
    cols = dict.fromkeys([*keep, *filter(None, weights), *[c for c in df.columns if c not in set(feature_cols)]])
    out = assembler(feature_cols).transform(df).select(*[F.col(f"`{c}`") for c in cols], FEATURES).checkpoint()
    return out.coalesce(n_parts(out.count(), df.sparkSession.sparkContext.defaultParallelism))


def n_parts(rows: int, cores: int) -> int:
    """Parts for the rows of a tree fit: a multiple of ``cores``."""
    return cores * max(1, math.ceil(rows / (cores * ROWS_PER_TASK)))


def fit_pipeline(df: DataFrame, feature_cols: list[str], estimator) -> PipelineModel:
    """Assembler + estimator; NULL features raise (impute first, S12). Rows of ``assembled`` are taken as
    they are."""
    asm = assembler(feature_cols, estimator.getFeaturesCol())
    rows = df if estimator.getFeaturesCol() in df.columns else asm.transform(df)
    return PipelineModel([asm, grow.fit(estimator, rows)])


def gbt_classifier(train: DataFrame, feature_cols: list[str], label: str = "loan_status",
                   preset: str = "a", seed: int = 42, weight_col: str | None = None,
                   **overrides) -> PipelineModel:
    est = gbt_estimator(label, preset, seed, weight_col, **overrides)
    return fit_pipeline(assembled(train, feature_cols, [label], [est]), feature_cols, est)


def gbt_subsampled(train: DataFrame, feature_cols: list[str], label: str = "loan_status",
                   seed: int = 42, **overrides) -> PipelineModel:
    return gbt_classifier(train, feature_cols, label, "subsampled", seed, **overrides)


def early_stop_fit(train: DataFrame, feature_cols: list[str], label: str = "loan_status",
                   holdout_frac: float = 0.1, preset: str = "b", seed: int = 42, tol: float | None = None,
                   l2: float = 2.5, weight_col: str | None = None, **overrides) -> leaves.LeafModel:
    """The best prefix of the preset's trees: leaves get L2-regularised values (``l2``; 0 keeps Spark's),
    every prefix is scored on a held-out slice of ``train`` (kept apart from any evaluation set, Q18), and
    the model is cut behind the highest AUC. All trees are fitted, unless ``tol`` stops the fit where the
    slice's log loss falls by less than that share."""
    from credora.operators.sample import stratified_split

    marked = stratified_split(train, label, holdout_frac, seed, split_col="_es") \
        .withColumn("_is_val", F.col("_es") == "test").drop("_es").checkpoint()
    est = gbt_estimator(label, preset, seed, weight_col, **overrides)
    marked = assembled(marked, feature_cols, [label, "_is_val"], [est])
    part, valid = marked.where("NOT _is_val"), marked.where("_is_val")
    if tol is not None:
        est.setParams(validationIndicatorCol="_is_val", validationTol=tol)
    model = fit_pipeline(part if tol is None else marked, feature_cols, est)
    fitted = leaves.refit_leaves(model, part, label, l2, weight_col=weight_col) if l2 else leaves.as_fitted(model)
    return leaves.best_prefix(fitted, valid, label)[0]


def predict(model: PipelineModel | leaves.LeafModel, df: DataFrame, keep: list[str] | None = None,
            threshold: float | None = None, score_col: str = "score",
            pred_col: str = "prediction") -> DataFrame:
    """Score P(1) and class; ``threshold`` overrides the model's 0.5 cut."""
    if isinstance(model, leaves.LeafModel):
        return model.predict(df, keep, 0.5 if threshold is None else threshold, score_col, pred_col)
    # rows of ``assembled`` need the last stage only
    ready = model.stages[-1].getFeaturesCol() in df.columns
    out = (model.stages[-1] if ready else model).transform(df).withColumn(score_col, vector_to_array("probability")[1])
    if threshold is not None:
        out = out.withColumn(pred_col, (F.col(score_col) > F.lit(threshold)).cast("double"))
    cols = list(keep or []) + [score_col, pred_col]
    return out.select(*[F.col(f"`{c}`") for c in cols])


def feature_importance(model: PipelineModel, feature_cols: list[str], top: int = 10):
    """(feature, importance) strongest first; Spark's impurity-gain importance."""
    trees = model.model if isinstance(model, leaves.LeafModel) else model
    imp = trees.stages[-1].featureImportances.toArray()
    spark = SparkSession.getActiveSession()
    rows = sorted(zip(feature_cols, [float(v) for v in imp]), key=lambda r: -r[1])[:top]
    return spark.createDataFrame(rows, "feature string, importance double")


def run_parallel(fn, items: list, max_parallel: int | None = None) -> list:
    """Apply ``fn`` to every item from a thread pool (each call submits Spark jobs);
    results in item order."""
    from concurrent.futures import ThreadPoolExecutor

    workers = max(1, min(len(items), max_parallel or len(items)))
    if workers == 1:
        return [fn(x) for x in items]
    with ThreadPoolExecutor(max_workers=workers) as pool:
        return list(pool.map(fn, items))


@dataclass
class CVResult:
    fold_auc: list[float]

    @property
    def mean(self) -> float:
        return float(np.mean(self.fold_auc))

    @property
    def spread(self) -> float:
        """2 x population std, as the reference reports."""
        return float(2 * np.std(self.fold_auc))


def cross_val_auc(df: DataFrame, feature_cols: list[str], make_estimator, label: str = "loan_status",
                  fold_col: str = "fold", k: int = 5, seed: int = 42, resample=None,
                  max_parallel: int | None = None) -> DataFrame:
    """Fit on fold != f, score fold == f, tie-exact AUC per fold; rows (fold, auc)
    plus 'mean' and 'spread'. ``resample(train_part)`` runs inside each fold (sound
    CV: synthetic rows never reach a validation fold)."""
    from credora.operators.sample import stratified_kfold

    if fold_col not in df.columns:
        # written once: every fold's fit and scoring reads it instead of assigning folds again
        df = stratified_kfold(df, label, k, seed, fold_col=fold_col).checkpoint()

    if resample is None:
        df = assembled(df, feature_cols, [fold_col, label], [make_estimator()])

    def one(f: int) -> float:
        tr = df.where(F.col(fold_col) != f)
        if resample is not None:
            tr = resample(tr)
        model = fit_pipeline(tr, feature_cols, make_estimator())
        scored = predict(model, df.where(F.col(fold_col) == f), keep=[label])
        return roc_auc(scored, label, "score").first()["auc"]

    # folds are independent Spark jobs: submitting them together lets the scheduler
    # overlap their (small) tree-building stages
    aucs = run_parallel(one, list(range(k)), max_parallel)
    res = CVResult(aucs)
    spark = df.sparkSession
    rows = [(str(i), a) for i, a in enumerate(aucs)] + [("mean", res.mean), ("spread", res.spread)]
    return spark.createDataFrame(rows, "fold string, auc double")
