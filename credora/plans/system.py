"""End-to-end credit system: engineer, encode, freeze features, split, scale,
(PCA), resample, fit, evaluate; then predict with everything fitted at train time.

One object holds the fitted state (medians, category levels, frozen feature list,
scaler, optional PCA, model, threshold) and saves / loads it whole (Q7). Predict
reuses training medians unless ``frame_medians=True`` asks for the reference's
per-frame behaviour (Q1). Resampling touches the training part only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credora.operators import encode, features, knn, metrics, sample, scale
from credora.operators.pca import PCAModel, fit_pca
from credora.plans import boosted, leaves, stack
from credora.sources.persist import read_params, write_params

# The reference's categorical roles.
LABEL_ENCODED = ["person_home_ownership", "loan_intent", "loan_grade", "cb_person_default_on_file"]
ONE_HOT = ["person_home_ownership", "loan_intent", "loan_grade"]
ONE_HOT_PREFIX = ["home", "intent", "grade"]
DROP = ["id", "cb_person_default_on_file"]


@dataclass
class CreditSystem:
    variant: str = "basic"            # "basic": ratio/bin features; "full": log/sqrt set
    label: str = "loan_status"
    id_col: str = "id"
    use_smote: bool = True
    smote_ratio: float = 0.5
    use_pca: bool = False
    pca_variance: float = 0.95
    preset: str = "a"
    model_params: dict = field(default_factory=dict)
    balanced_weights: bool = False
    best_prefix: bool = False         # L2 leaves, and the trees up to the best AUC on a held-out slice
    frame_medians: bool = False
    test_frac: float = 0.2
    seed: int = 42
    # fitted state
    medians: dict | None = None
    levels: dict | None = None
    feature_cols: list | None = None
    scaler: scale.Scaler | None = None
    pca: PCAModel | None = None
    pca_k: int | None = None
    model: PipelineModel | leaves.LeafModel | None = None
    threshold: float = 0.5

    # ------------------------------------------------------------------ features
    def _engineer(self, df: DataFrame, fit: bool) -> DataFrame:
        med = None if (fit or self.frame_medians) else self.medians
        if fit:
            need = [c for c in ("person_emp_length", "loan_int_rate") if c in df.columns]
            self.medians = med = features.fit_medians(df, need)
        fn = features.engineer_basic if self.variant == "basic" else features.engineer_full
        return fn(df, med)

    def prepare(self, df: DataFrame, fit: bool = False) -> DataFrame:
        """Feature table (id, [label], frozen features...)."""
        out = self._engineer(df, fit)
        cats = [c for c in LABEL_ENCODED if c in out.columns]
        if fit:
            self.levels = encode.fit_categories(out, cats)
        out = encode.label_encode(out, cats, self.levels)
        out = encode.one_hot_full(out, ONE_HOT, ONE_HOT_PREFIX,
                                  {c: self.levels[c] for c in ONE_HOT})
        keep = [self.id_col] + ([self.label] if self.label in out.columns else [])
        feats = [c for c in out.columns if c not in set(DROP) | {self.label}]
        if fit:
            self.feature_cols = feats
        return features.align_columns(out, keep + self.feature_cols)

    def _model_space(self, df: DataFrame, keep: list[str]) -> tuple[DataFrame, list[str]]:
        out = self.scaler.transform(df)
        if self.pca is None:
            return out, self.feature_cols
        pcs = [f"PC{j + 1}" for j in range(self.pca_k)]
        return self.pca.transform(out, self.pca_k, keep=keep), pcs

    # ------------------------------------------------------------------ train / predict
    def train(self, df: DataFrame, cv_folds: int = 0) -> dict:
        """Fit everything on ``df``; returns report tables (validation part)."""
        # written once: medians, levels and ranks are passes of their own
        prepared = self.prepare(df.checkpoint(), fit=True)
        # one written table feeds the scaler, PCA, resampling and the fit (lineage cut)
        split = sample.stratified_split(prepared, self.label, self.test_frac, self.seed).checkpoint()
        train = split.where("split = 'train'").drop("split")
        valid = split.where("split = 'test'").drop("split")
        self.scaler = scale.fit_robust(train, self.feature_cols)
        keep = [self.id_col, self.label]
        if self.use_pca:
            self.pca = fit_pca(self.scaler.transform(train), self.feature_cols, standardize=False)
            self.pca_k = self.pca.n_for_variance(self.pca_variance)
        tr, cols = self._model_space(train, keep)
        va, _ = self._model_space(valid, keep)
        real = tr.select(*keep, *cols).checkpoint()

        def balanced(part: DataFrame) -> DataFrame:
            """A training part with synthetic rows and class weights, as the settings ask."""
            if self.use_smote:
                part = knn.smote(part, cols, self.label, 1, self.smote_ratio, 5, self.seed,
                                 self.id_col).drop("synthetic")
            return sample.with_class_weight(part, self.label, "_w") if self.balanced_weights else part

        weight = "_w" if self.balanced_weights else None
        tr = balanced(real).checkpoint()
        va = va.checkpoint()
        self._fit_model(tr, va, cols, weight)
        scored = self._score(va, keep)
        report = {
            "classification_report": metrics.classification_report(scored, self.label),
            "roc_auc": metrics.roc_auc(scored, self.label, "score"),
            **self._more_reports(cols),
        }
        if cv_folds:
            make = lambda: boosted.gbt_estimator(self.label, self.preset, self.seed, weight,
                                                 **self.model_params)
            # folds are cut from real rows; synthetic ones are made inside each training part
            report["cv"] = boosted.cross_val_auc(real, cols, make, self.label, k=cv_folds,
                                                 seed=self.seed, resample=lambda p: balanced(
                                                     p.select(*keep, *cols)).checkpoint())
        return report

    # the model of this system; subclasses bring another one
    def _fit_model(self, train: DataFrame, valid: DataFrame, cols: list[str], weight: str | None) -> None:
        if self.best_prefix:
            self.model = boosted.early_stop_fit(train, cols, self.label, preset=self.preset, seed=self.seed,
                                                weight_col=weight, **self.model_params)
        else:
            self.model = boosted.gbt_classifier(train, cols, self.label, self.preset, self.seed, weight,
                                                **self.model_params)

    def _score(self, df: DataFrame, keep: list[str], threshold: float | None = None) -> DataFrame:
        return boosted.predict(self.model, df, keep=keep, threshold=threshold)

    def _more_reports(self, cols: list[str]) -> dict:
        return {"feature_importance": boosted.feature_importance(self.model, cols, 10)}

    def _save_model(self, path: str) -> dict:
        if self.best_prefix:
            return self.model.save(f"{path}/model")
        self.model.write().overwrite().save(f"{path}/model")
        return {}

    def _load_model(self, path: str, saved: dict) -> None:
        self.model = leaves.LeafModel.load(f"{path}/model", saved) if self.best_prefix else \
            PipelineModel.load(f"{path}/model")

    def predict(self, df: DataFrame, threshold: float | None = None) -> DataFrame:
        """(id, prediction, score) for every row of ``df``."""
        if self.model is None:
            raise ValueError("model not trained: call train() first")
        prepared = self.prepare(df, fit=False)
        x, _ = self._model_space(prepared, [self.id_col])
        t = self.threshold if threshold is None else threshold
        out = self._score(x, [self.id_col], t)
        return out.select(self.id_col, F.col("prediction").cast("bigint").alias("prediction"), "score")

    # ------------------------------------------------------------------ persistence
    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        saved = self._save_model(path)
        params = {k: getattr(self, k) for k in (
            "variant", "label", "id_col", "use_smote", "smote_ratio", "use_pca", "pca_variance",
            "preset", "model_params", "balanced_weights", "best_prefix", "frame_medians", "test_frac", "seed",
            "medians", "levels", "feature_cols", "pca_k", "threshold")}
        params["scaler"] = self.scaler.to_dict()
        if self.pca is not None:
            params["pca"] = {"cols": self.pca.cols, "mean": self.pca.mean, "scale": self.pca.scale,
                             "components": self.pca.components.tolist(),
                             "ratio": self.pca.explained_variance_ratio}
        write_params(spark, {**params, "saved_model": saved}, f"{path}/params")

    @classmethod
    def load(cls, path: str) -> "CreditSystem":
        spark = SparkSession.getActiveSession()
        p = read_params(spark, f"{path}/params")
        sc, pc, saved = p.pop("scaler"), p.pop("pca", None), p.pop("saved_model", {})
        sys_ = cls(**p)
        sys_.scaler = scale.Scaler(sc["center"], sc["scale"])
        if pc:
            sys_.pca = PCAModel(pc["cols"], pc["mean"], pc["scale"], np.array(pc["components"]),
                                pc["ratio"])
        sys_._load_model(path, saved)
        return sys_


@dataclass
class StackSystem(CreditSystem):
    """The ensemble end to end: the same preparation and resampling, a stack of three base models
    under a meta model, and the threshold with the best F1 on the validation part. ``model_params``:
    ``maxIter`` for all learners (default: their presets), ``folds`` for the out-of-fold scores."""

    def _learners(self) -> tuple[dict, object, int]:
        most = self.model_params.get("maxIter")
        meta = {"maxIter": most} if most else {}
        return (stack.default_learners(self.label, self.seed, most),
                lambda: boosted.gbt_estimator(self.label, "meta", self.seed, **meta),
                self.model_params.get("folds", 5))

    def _fit_model(self, train: DataFrame, valid: DataFrame, cols: list[str], weight: str | None) -> None:
        learners, meta, folds = self._learners()
        self.model = stack.stack_fit(train, cols, self.label, learners, meta, self.id_col, folds,
                                     self.seed, valid)
        self.threshold = self.model.threshold

    def _score(self, df: DataFrame, keep: list[str], threshold: float | None = None) -> DataFrame:
        rest = [c for c in keep if c != self.id_col]
        return self.model.predict(df, self.id_col, rest, self.threshold if threshold is None else threshold)

    def _more_reports(self, cols: list[str]) -> dict:
        return {}

    def _save_model(self, path: str) -> dict:
        return self.model.save(path)

    def _load_model(self, path: str, saved: dict) -> None:
        self.model = stack.StackModel.load(path, saved)
