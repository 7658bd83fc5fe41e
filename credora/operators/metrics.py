"""Binary-classification evaluation as aggregates over (label, score | prediction).

Curves and AUC collapse rows to distinct scores first, then use bucketed running
sums, so no step needs a global single-task window. ``part_cols`` evaluates several
models (a long table keyed by model) in the same jobs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credora.operators.running import prefix_sums

# The reference's F1 sweep, 80 evenly spaced thresholds from 0.1 to 0.9.
F1_SWEEP = [float(t) for t in np.linspace(0.1, 0.9, 80)]


def _cnt(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def confusion_matrix(df: DataFrame, label: str = "loan_status", pred: str = "prediction"
                     ) -> DataFrame:
    """(actual, predicted, count) for the full 2 x 2 grid, zero cells kept."""
    y, p = F.col(label), F.col(pred)
    row = df.agg(*[_cnt((y == a) & (p == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)])
    cells = [F.struct(F.lit(a).cast("bigint").alias("actual"), F.lit(b).cast("bigint").alias("predicted"),
                      F.col(f"c{a}{b}").alias("count")) for a in (0, 1) for b in (0, 1)]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def _div0(a: Column, b: Column) -> Column:
    """a / b with 0 for a zero denominator (zero_division=0)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binary_scores(df: DataFrame, label: str = "loan_status", pred: str = "prediction") -> DataFrame:
    y, p = F.col(label), F.col(pred)
    c = df.agg(_cnt((y == 1) & (p == 1)).alias("tp"), _cnt((y == 0) & (p == 1)).alias("fp"),
               _cnt((y == 1) & (p == 0)).alias("fn"), _cnt((y == 0) & (p == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    prec, rec = _div0(tp, tp + fp), _div0(tp, tp + fn)
    return c.select(_div0(tp + tn, tp + fp + fn + tn).alias("accuracy"), prec.alias("precision"),
                    rec.alias("recall"), _div0(2 * tp, 2 * tp + fp + fn).alias("f1"))


def classification_report(df: DataFrame, label: str = "loan_status", pred: str = "prediction"
                          ) -> DataFrame:
    """Rows '0', '1', 'accuracy', 'macro avg', 'weighted avg' with precision, recall,
    f1 and support (accuracy row: f1 = accuracy, precision / recall NULL)."""
    y, p = F.col(label), F.col(pred)
    c = df.agg(_cnt((y == 1) & (p == 1)).alias("tp"), _cnt((y == 0) & (p == 1)).alias("fp"),
               _cnt((y == 1) & (p == 0)).alias("fn"), _cnt((y == 0) & (p == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    p1, r1 = _div0(tp, tp + fp), _div0(tp, tp + fn)
    p0, r0 = _div0(tn, tn + fn), _div0(tn, tn + fp)
    f1_1, f1_0 = _div0(2 * tp, 2 * tp + fp + fn), _div0(2 * tn, 2 * tn + fn + fp)
    s1, s0 = tp + fn, tn + fp
    w = lambda a, b: (a * s0 + b * s1) / n
    null = F.lit(None).cast("double")
    rows = [
        ("0", p0, r0, f1_0, s0), ("1", p1, r1, f1_1, s1),
        ("accuracy", null, null, _div0(tp + tn, n), n),
        ("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n),
        ("weighted avg", w(p0, p1), w(r0, r1), w(f1_0, f1_1), n),
    ]
    return c.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("class_name"), a.alias("precision"), b.alias("recall"),
                 f.alias("f1"), s.cast("bigint").alias("support")) for k, a, b, f, s in rows
    ])).alias("r")).select("r.*")


def _score_counts(df: DataFrame, label: str, score: str, parts: list[str]) -> DataFrame:
    """(parts..., s, n0, n1): one row per distinct score."""
    y = F.col(label)
    return df.where(F.col(score).isNotNull()).groupBy(*parts, F.col(score).alias("s")).agg(
        _cnt(y == 0).alias("n0"), _cnt(y == 1).alias("n1"))


def roc_auc(df: DataFrame, label: str = "loan_status", score: str = "score",
            part_cols: list[str] | None = None) -> DataFrame:
    """Tie-exact AUC = sum over distinct scores of n1 * (n0 below + n0 / 2) / (N0 N1)."""
    parts = list(part_cols or [])
    sc = prefix_sums(_score_counts(df, label, score, parts), ["s"], ["n0", "n1"], parts)
    term = F.col("n1") * (F.col("n0_before") + F.col("n0") / 2.0)
    agg = sc.groupBy(*parts).agg(F.sum(term).alias("_num"), F.first("n0_total").alias("_N0"),
                                 F.first("n1_total").alias("_N1"))
    return agg.select(*parts, F.try_divide(F.col("_num"), F.col("_N0") * F.col("_N1")).alias("auc"))


def roc_curve(df: DataFrame, label: str = "loan_status", score: str = "score",
              part_cols: list[str] | None = None, drop_intermediate: bool = False) -> DataFrame:
    """(threshold, fpr, tpr): one point per distinct score (predict positive when
    score >= threshold), from (inf, 0, 0). ``drop_intermediate`` removes points on a straight
    segment with equal steps: those whose score and the next lower one add the same (integer)
    counts of both classes."""
    parts = list(part_cols or [])
    counts = _score_counts(df, label, score, parts).withColumn("one", F.lit(1).cast("bigint"))
    sc = prefix_sums(counts, ["s"], ["n0", "n1", "one"], parts)
    start = sc.groupBy(*parts).agg(F.lit(float("inf")).alias("threshold"),
                                   F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    if drop_intermediate:
        lower = sc.select(*[F.col(c).alias(f"_l_{c}") for c in parts],
                          (F.col("one_before") + 1).alias("_place"),
                          F.col("n0").alias("_n0"), F.col("n1").alias("_n1"))
        near = F.col("one_before") == F.col("_place")
        for c in parts:
            near = near & F.col(c).eqNullSafe(F.col(f"_l_{c}"))
        sc = sc.join(lower, near, "left").where(
            F.col("_place").isNull() | (F.col("n0") != F.col("_n0")) | (F.col("n1") != F.col("_n1")))
    fp = F.col("n0_total") - F.col("n0_before")
    tp = F.col("n1_total") - F.col("n1_before")
    pts = sc.select(*parts, F.col("s").cast("double").alias("threshold"),
                    F.try_divide(fp.cast("double"), F.col("n0_total")).alias("fpr"),
                    F.try_divide(tp.cast("double"), F.col("n1_total")).alias("tpr"))
    return pts.unionByName(start)


def pr_curve(df: DataFrame, label: str = "loan_status", score: str = "score",
             part_cols: list[str] | None = None) -> DataFrame:
    """(threshold, precision, recall) per distinct score, plus the end point
    (NULL, 1, 0)."""
    parts = list(part_cols or [])
    sc = prefix_sums(_score_counts(df, label, score, parts), ["s"], ["n0", "n1"], parts)
    fp = F.col("n0_total") - F.col("n0_before")
    tp = F.col("n1_total") - F.col("n1_before")
    pts = sc.select(*parts, F.col("s").cast("double").alias("threshold"),
                    _div0(tp, tp + fp).alias("precision"),
                    F.when(F.col("n1_total") == 0, F.lit(1.0))
                    .otherwise(tp / F.col("n1_total").cast("double")).alias("recall"))
    end = sc.groupBy(*parts).agg(F.lit(None).cast("double").alias("threshold"),
                                 F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def _count_below(value: Column, ts: list[float]) -> Column:
    """Number of sorted thresholds strictly below ``value`` (CASE tree, codegen'd)."""
    def rec(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(value > F.lit(ts[mid - 1]), rec(mid, hi)).otherwise(rec(lo, mid - 1))
    return rec(0, len(ts))


def f1_threshold_sweep(df: DataFrame, label: str = "loan_status", score: str = "score",
                       thresholds: list[float] | None = None) -> DataFrame:
    """F1 of ``score > t`` for every threshold in one pass: each row goes to the
    group 'number of thresholds below my score', then suffix sums over len+1 groups.
    ``best`` marks the first maximum."""
    ts = sorted(thresholds or F1_SWEEP)
    spark = df.sparkSession
    y = F.col(label)
    g = df.where(F.col(score).isNotNull()).groupBy(_count_below(F.col(score), ts).alias("k")).agg(
        _cnt(y == 0).alias("n0"), _cnt(y == 1).alias("n1"))
    # suffix sums over the len+1 group table (bounded by the threshold count): rows in
    # group k > j are predicted positive at threshold j.
    grid = spark.range(0, len(ts) + 1).select(F.col("id").cast("int").alias("k"))
    tdf = spark.createDataFrame([(j + 1, t) for j, t in enumerate(ts)], "k int, threshold double")
    w = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    pos = grid.join(g, "k", "left").fillna(0, ["n0", "n1"]).select(
        (F.col("k") - 1).alias("j"), "k", F.sum("n1").over(w).alias("tp"),
        F.sum("n0").over(w).alias("fp"), F.sum("n1").over(Window.partitionBy()).alias("n1")) \
        .join(tdf, "k")
    n1 = F.col("n1")
    tp, fp = F.col("tp"), F.col("fp")
    fn = n1 - tp
    out = pos.select("j", "threshold", _div0(2 * tp, 2 * tp + fp + fn).alias("f1"),
                     _div0(tp, tp + fp).alias("precision"), _div0(tp, n1).alias("recall"))
    best = out.agg(F.min_by("j", F.struct(-F.col("f1"), F.col("j"))).alias("bj")).scalar()
    return out.select("threshold", "f1", "precision", "recall",
                      (F.col("j") == best).cast("int").alias("best"))


def _model_scores(df: DataFrame, label: str, score_cols: list[str], with_mean: bool) -> DataFrame:
    """Long (label, model, score) of every model and of their mean."""
    cols = list(score_cols)
    base = df.select(label, *cols)
    if with_mean:
        base = base.withColumn("mean", sum(F.col(c) for c in cols) / len(cols))
        cols = cols + ["mean"]
    return base.unpivot([label], cols, "model", "score")


def model_comparison(df: DataFrame, label: str, score_cols: list[str],
                     with_mean: bool = True) -> DataFrame:
    """AUC of each model's score and of their mean, from one long (model, score) table."""
    return roc_auc(_model_scores(df, label, score_cols, with_mean), label, "score", ["model"])


def model_curves(df: DataFrame, label: str, score_cols: list[str], with_mean: bool = True,
                 drop_intermediate: bool = True) -> DataFrame:
    """ROC points (model, threshold, fpr, tpr) of each model's score and of their mean."""
    return roc_curve(_model_scores(df, label, score_cols, with_mean), label, "score", ["model"],
                     drop_intermediate)


def prediction_shares(df: DataFrame, pred: str = "prediction") -> DataFrame:
    from credora.operators.profile import value_counts
    return value_counts(df, pred)
