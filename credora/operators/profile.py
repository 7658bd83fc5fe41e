"""Profiling: shape, column inventory, nulls, describe, value and class counts.

Every operator is a single aggregate pass (or one pass plus an exact-quantile
selection); wide one-row results are turned long with ``unpivot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credora.operators.quantile import grid_of, wide_quantiles, wide_sketches

_FLOATS = (T.DoubleType, T.FloatType)


def _long(df: DataFrame, cols: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide numeric columns to (column, value) doubles."""
    return df.select(*[F.col(c).cast("double").alias(c) for c in cols]) \
        .unpivot([], cols, name, value)


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")) \
        .select("n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_cols"))


def column_info(df: DataFrame) -> DataFrame:
    """(position, column, dtype, non_null): one count(col) per column in a single pass."""
    spark = df.sparkSession
    meta = spark.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position bigint, feature string, dtype string")
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]) \
        .unpivot([], df.columns, "feature", "non_null")
    return meta.join(counts, "feature").select("position", "feature", "dtype", "non_null")


def null_counts(df: DataFrame, only_positive: bool = True) -> DataFrame:
    """(column, nulls); floating NaN counts as missing, as in the reference."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, _FLOATS)}
    aggs = [F.sum(F.when(F.col(c).isNull() | (F.isnan(F.col(c)) if c in floats else F.lit(False)),
                         1).otherwise(0)).cast("bigint").alias(c) for c in df.columns]
    out = df.agg(*aggs).unpivot([], df.columns, "feature", "nulls")
    return out.where(F.col("nulls") > 0) if only_positive else out


def describe(df: DataFrame, cols: list[str], probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """count, mean, sample std, min, quartiles (exact, linear), max per column.

    One aggregate gives the moments and sketches of all columns, one more pass the ranks around the
    quartiles; nothing is written but the few values near them."""
    probs = list(probs)
    found = wide_sketches(df, cols, grid_of(probs), count=F.count, mean=F.avg, std=F.stddev_samp, min=F.min, max=F.max)
    q = wide_quantiles(df, cols, probs, sketches=found)
    rows = [(c, m["count"], m["mean"], m["std"], m["min"], *[q.get((c, p)) for p in probs], m["max"])
            for c, m in found.items()]
    return df.sparkSession.createDataFrame(rows, _describe_schema(probs))


def _describe_schema(probs: list[float]) -> str:
    names = [{0.25: "q25", 0.5: "q50", 0.75: "q75"}.get(p, f"q{int(p * 100)}") for p in probs]
    return ", ".join(["feature string", "count bigint", "mean double", "std double", "min double"]
                     + [f"{n} double" for n in names] + ["max double"])


# ---------------------------------------------------------------- stored, mergeable state
def profile_state(df: DataFrame, cols: list[str], by: list[str] | None = None, k: int = 800) -> DataFrame:
    """(by..., feature, count, mean, m2, min, max, sketch): moments and a KLL sketch of each column, for each
    file, day or other group. States of parts merge to the state of the whole (``merge_states``), so a
    grown table is profiled from its new part alone. A sketch's rank error is about 2 / k (NaN and NULL
    are left out; a column without values has count 0)."""
    by = list(by or [])
    v = F.when(~F.isnan("value"), F.col("value"))
    long = df.select(*by, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).unpivot(by, cols, "feature", "value")
    return long.groupBy(*by, "feature").agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"),
        F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias("m2"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))


def merge_states(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """States of the groups ``by`` (default: one for each feature) from those of their parts."""
    keys = [*(by or []), "feature"]
    n = F.sum("count")
    whole = states.groupBy(*[F.col(c).alias(f"_k_{c}") for c in keys]).agg(
        F.try_divide(F.sum(F.col("count") * F.col("mean")), n).alias("_mean"))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    apart = F.col("count") * (F.col("mean") - F.col("_mean")) ** 2
    return states.join(whole, same).groupBy(*keys).agg(
        n.alias("count"), F.first("_mean").alias("mean"),
        (F.sum("m2") + F.coalesce(F.sum(apart), F.lit(0.0))).alias("m2"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_double("sketch").alias("sketch"))


def describe_states(states: DataFrame, by: list[str] | None = None, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """``describe`` from stored states, quartiles within the sketches' rank error; no table is read."""
    by, probs = list(by or []), list(probs)
    merged = merge_states(states, by)
    names = [x.split()[0] for x in _describe_schema(probs).split(", ")][5:-1]
    some = F.col("count") > 0
    q = [F.when(some, F.kll_sketch_get_quantile_double("sketch", F.lit(p))).alias(c) for p, c in zip(probs, names)]
    std = F.when(F.col("count") > 1, F.sqrt(F.col("m2") / (F.col("count") - 1))).alias("std")
    return merged.select(*by, "feature", "count", "mean", std, "min", *q, "max")


def preview(df: DataFrame, n: int = 5, order_col: str = "id") -> DataFrame:
    """First n rows by key (a top-k: each task keeps n rows)."""
    return df.orderBy(order_col).limit(n)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, count, share), most frequent first; nulls dropped. The total is a
    scalar subquery over the (small) per-value counts."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.select(F.col(col).alias("value"), "count",
                         (F.col("count") / total).alias("share")) \
        .orderBy(F.desc("count"), "value")


def class_counts(df: DataFrame, label: str = "loan_status", classes=(0, 1)) -> DataFrame:
    """Count per class over a fixed class list (absent classes give 0)."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(int(c),) for c in classes], "class bigint")
    counts = df.groupBy(F.col(label).cast("bigint").alias("class")).agg(
        F.count(F.lit(1)).alias("count"))
    return grid.join(counts, "class", "left") \
        .select("class", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def imbalance_ratio(df: DataFrame, label: str = "loan_status") -> DataFrame:
    y = F.col(label)
    return df.agg(F.sum(F.when(y == 0, 1).otherwise(0)).cast("bigint").alias("n0"),
                  F.sum(F.when(y == 1, 1).otherwise(0)).cast("bigint").alias("n1")) \
        .select("n0", "n1", F.try_divide(F.col("n0").cast("double"), F.col("n1")).alias("ratio"))


def class_shares_and_weight(df: DataFrame, label: str = "loan_status") -> DataFrame:
    """Shares of 0 and 1 and ``pos_weight = share0 / share1`` (the loss weight)."""
    y = F.col(label)
    return df.agg(F.avg(F.when(y == 0, 1.0).otherwise(0.0)).alias("share0"),
                  F.avg(F.when(y == 1, 1.0).otherwise(0.0)).alias("share1")) \
        .select("share0", "share1", F.try_divide("share0", "share1").alias("pos_weight"))


def distinct_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value) for each categorical column; one shuffle for all columns."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in cols]) \
        .unpivot([], cols, "feature", "value").where(F.col("value").isNotNull()).distinct()


def feature_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Min of mins, max of maxes, mean of means, mean of population stds over features."""
    long = _long(df, cols)
    per = long.groupBy("feature").agg(F.min("value").alias("mn"), F.max("value").alias("mx"),
                                     F.avg("value").alias("mean"),
                                     F.stddev_pop("value").alias("sd"))
    return per.agg(F.min("mn").alias("min"), F.max("mx").alias("max"),
                   F.avg("mean").alias("mean"), F.avg("sd").alias("std"))


def quality_check(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per feature: NaN count, infinite count, NaN-skipping finite min / max; plus an
    ``__all__`` row with the totals."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]) \
        .unpivot([], cols, "feature", "value")
    v = F.col("value")
    finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    per = long.groupBy("feature").agg(
        F.sum(F.when(F.isnan(v), 1).otherwise(0)).cast("bigint").alias("nan_count"),
        F.sum(F.when(F.abs(v) == float("inf"), 1).otherwise(0)).cast("bigint").alias("inf_count"),
        F.min(finite).alias("min"), F.max(finite).alias("max"))
    total = per.agg(F.lit("__all__").alias("feature"), F.sum("nan_count").cast("bigint").alias("nan_count"),
                    F.sum("inf_count").cast("bigint").alias("inf_count"),
                    F.min("min").alias("min"), F.max("max").alias("max"))
    return per.unionByName(total)
