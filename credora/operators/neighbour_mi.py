"""Mutual information of a continuous column and a class by nearest neighbours (Ross's estimator).

For each row: d is the distance to its k-th nearest other row of the same class, and m the number of rows of
any class whose value lies strictly between v - d and v + d (d = 0: equals v). Then
MI = psi(N) + mean psi(k) - mean psi(N_class) - mean psi(m), at least 0.

Sorted order comes from bucketed running sums, so no task holds a column: equal values of a class are one
point with a weight and a number in the order of its class; a point is sent to the numbers of its k
neighbours on either side, where a group has at most 2 k + 1 points; the ends of all intervals are placed
among the values by one more running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credora.operators.running import prefix_sums


def digamma(x: Column) -> Column:
    """psi of a number of at least 1: six steps of the recurrence, then the asymptotic series."""
    y = x.cast("double") + 6
    q = 1 / (y * y)
    series = q * (F.lit(1 / 12) - q * (F.lit(1 / 120) - q * (F.lit(1 / 252) - q * (F.lit(1 / 240) - q / 132))))
    steps = sum((1 / (x.cast("double") + j) for j in range(6)), F.lit(0.0))
    return F.log(y) - 1 / (2 * y) - series - steps


def _distances(points: DataFrame, k: int) -> DataFrame:
    """``points`` (feature, class, v, w, class_n) with d and the used number of neighbours ``near``."""
    part = ["feature", "class"]
    numbered = prefix_sums(points.withColumn("one", F.lit(1)), ["v"], ["one"], part)
    sent = numbered.select(*part, "v", "w", "class_n", F.explode(F.sequence(F.lit(-k), F.lit(k))).alias("step"),
                           F.col("one_before").alias("own")).withColumn("at", F.col("own") + F.col("step"))
    mine = F.max(F.when(F.col("step") == 0, F.struct("v", "w", "class_n")))
    met = sent.groupBy(*part, "at").agg(mine.alias("me"), F.collect_list(F.struct("v", "w", "step")).alias("all")) \
        .where("me IS NOT NULL")
    near = F.least(F.lit(k), F.col("me.class_n") - 1)
    gaps = F.array_sort(F.transform("all", lambda x: F.struct(
        F.abs(x["v"] - F.col("me.v")).alias("gap"),
        (x["w"] - F.when(x["step"] == 0, 1).otherwise(0)).cast("long").alias("w"))))
    start = F.struct(F.lit(0).cast("long").alias("rows"), F.lit(0.0).alias("d"))
    reach = F.aggregate(gaps, start, lambda a, x: F.when(
        (a["rows"] >= F.col("near")) | (x["w"] == 0), a).otherwise(
        F.struct((a["rows"] + x["w"]).alias("rows"), x["gap"].alias("d"))))
    return met.withColumn("near", near).select(*part, "me.v", "me.w", "me.class_n", "near", reach["d"].alias("d"))


def mutual_info_neighbours(df: DataFrame, cols: list[str], label: str = "loan_status", k: int = 3) -> DataFrame:
    """(feature, mi) in nats. Rows with a NULL or NaN value or a NULL class are left out, as are classes of a
    single row (``near`` is k, or all other rows of a smaller class); a column without rows has no result."""
    long = df.select(F.col(label).cast("string").alias("class"),
                     *[F.col(f"`{c}`").cast("double").alias(c) for c in cols]) \
        .unpivot(["class"], cols, "feature", "v").where("class IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)")
    counts = long.groupBy("feature", "class", "v").agg(F.count(F.lit(1)).alias("w"))
    totals = counts.groupBy(F.col("feature").alias("_f"), F.col("class").alias("_c")).agg(F.sum("w").alias("class_n")) \
        .where("class_n > 1")
    points = counts.join(totals, (F.col("feature") == F.col("_f")) & (F.col("class") == F.col("_c"))) \
        .drop("_f", "_c").checkpoint()
    found = _distances(points, k).checkpoint()
    # kind 0 stands before the rows of its value, 2 behind them
    inside = F.col("d") > 0
    ends = found.select("feature", "class", "v", F.explode(F.array(
        F.struct(F.when(inside, F.col("v") - F.col("d")).otherwise(F.col("v")).alias("at"),
                 F.when(inside, 2).otherwise(0).alias("kind"), F.lit(-1).alias("sign")),
        F.struct(F.when(inside, F.col("v") + F.col("d")).otherwise(F.col("v")).alias("at"),
                 F.when(inside, 0).otherwise(2).alias("kind"), F.lit(1).alias("sign")))).alias("end")) \
        .select("feature", "class", "v", "end.*")
    placed = points.select("feature", F.col("v").alias("at"), F.lit(1).alias("kind"), "w").unionByName(
        ends.select("feature", "at", "kind", F.lit(0).cast("long").alias("w")))
    ranked = prefix_sums(placed.groupBy("feature", "at", "kind").agg(F.sum("w").alias("w")).checkpoint(),
                         ["at", "kind"], ["w"], ["feature"]).select("feature", "at", "kind", "w_before")
    m = (ends.join(ranked, ["feature", "at", "kind"]).groupBy("feature", "class", "v")
         .agg(F.sum(F.col("sign") * F.col("w_before")).alias("m")))
    each = found.join(m, ["feature", "class", "v"])
    mean = lambda c: F.sum(F.col("w") * digamma(c)) / F.sum("w")
    mi = digamma(F.sum("w")) + mean(F.col("near")) - mean(F.col("class_n")) - mean(F.col("m"))
    return each.groupBy("feature").agg(F.greatest(mi, F.lit(0.0)).alias("mi"))
