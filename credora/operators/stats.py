"""Statistics and the tables behind the exploration charts.

Moments and contingency counts are single aggregate passes with map-side partial
aggregation. Rank statistics use the bucketed running sum (no single-task window),
quantiles use exact distributed selection. Per-column parameters (min/max,
bandwidths, quartiles) are tiny tables joined by broadcast: size = number of columns.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credora.functions.special import chi2_p, normal_two_sided_p
from credora.operators.gram import gram
from credora.operators.quantile import exact_quantiles
from credora.operators.running import prefix_sums


def _long(df: DataFrame, cols: list[str], extra: list[str] | None = None,
          cast: str = "double") -> DataFrame:
    extra = extra or []
    return df.select(*[F.col(e) for e in extra], *[F.col(f"`{c}`").cast(cast).alias(c) for c in cols]) \
        .unpivot(extra, cols, "feature", "value")


# ---------------------------------------------------------------- correlation
def _pair_corrs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(col_a, col_b, r) of the given pairs from pairwise complete rows, in one aggregate. A
    constant column gives NULL instead of raising (S2)."""
    aggs, rows = [], []
    for k, (a, b) in enumerate(pairs):
        x, y = F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")
        both = x.isNotNull() & y.isNotNull()
        aggs += [F.covar_pop(x, y).alias(f"c{k}"), F.stddev_pop(F.when(both, x)).alias(f"a{k}"),
                 F.stddev_pop(F.when(both, y)).alias(f"b{k}")]
        r = F.try_divide(F.col(f"c{k}"), F.col(f"a{k}") * F.col(f"b{k}"))
        rows.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                             F.when(F.abs(r) > 1, F.signum(r)).otherwise(r).alias("r")))
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson r for every ordered pair (long form, diagonal included), pairwise complete
    rows, from masked Gram matrices. A constant column gives NULL instead of raising (S2)."""
    r = gram(df, cols).correlation()
    d = len(cols)
    rows = pa.table({"col_a": np.repeat(cols, d), "col_b": np.tile(cols, d),
                     "r": pa.array(r.ravel(), pa.float64(), from_pandas=True)})
    return df.sparkSession.createDataFrame(rows)


def corr_with_label(df: DataFrame, cols: list[str], label: str = "loan_status") -> DataFrame:
    """r of each column with the label, strongest positive first; only these pairs are computed."""
    return _pair_corrs(df, [(c, label) for c in cols if c != label]) \
        .select(F.col("col_a").alias("feature"), "r").orderBy(F.desc_nulls_last("r"))


def high_corr_pairs(df: DataFrame, cols: list[str], threshold: float = 0.5) -> DataFrame:
    """Pairs (a before b in ``cols``) with |r| above the threshold."""
    r = gram(df, cols).correlation()
    found = [(cols[i], cols[j], float(r[i, j])) for i in range(len(cols)) for j in range(i + 1, len(cols))
             if abs(r[i, j]) > threshold]
    return df.sparkSession.createDataFrame(found, "col_a string, col_b string, r double")


def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    """Variance inflation = diagonal of the inverse correlation matrix (d x d on the
    driver; d is the number of features). Singular -> +inf."""
    R = gram(df, cols).correlation()
    try:
        inv = np.linalg.inv(R)
        vals = [float(v) for v in np.diag(inv)]
        if np.linalg.cond(R) > 1e12:
            vals = [float("inf")] * len(cols)
    except np.linalg.LinAlgError:
        vals = [float("inf")] * len(cols)
    return df.sparkSession.createDataFrame(list(zip(cols, vals)), "feature string, vif double")


# ---------------------------------------------------------------- shape
def skew_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """Bias-corrected sample skewness G1 = g1 * sqrt(n(n-1)) / (n-2), largest first (S5)."""
    long = _long(df, cols)
    per = long.groupBy("feature").agg(F.skewness("value").alias("g1"),
                                     F.count("value").cast("double").alias("n"))
    g = F.col("g1") * F.sqrt(F.col("n") * (F.col("n") - 1)) / (F.col("n") - 2)
    return per.select("feature", F.when(F.col("n") > 2, g).alias("skew")) \
        .orderBy(F.desc_nulls_last("skew"))


def _binned(long: DataFrame, params: DataFrame) -> DataFrame:
    """Bin codes from per-column (lo, hi, bins); last bin closed (S9)."""
    j = long.where(F.col("value").isNotNull()).join(F.broadcast(params), "feature")
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    b = F.least(F.col("bins") - 1, F.floor((F.col("value") - F.col("lo")) / width).cast("int"))
    return j.select("feature", "value", b.alias("bin"))


def _histogram_from_params(long: DataFrame, params: DataFrame) -> DataFrame:
    counts = _binned(long, params).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = params.select("feature", "lo", "hi", "bins",
                         F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    return grid.join(counts, ["feature", "bin"], "left").select(
        "feature", F.col("bins").alias("n_bins"), "bin",
        (F.col("lo") + F.col("bin") * width).alias("edge_lo"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("edge_hi"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def histogram(df: DataFrame, cols: list[str], bins: int = 50) -> DataFrame:
    """Equal-width bins over [min, max] per column, empty bins kept."""
    long = _long(df, cols)
    mm = long.groupBy("feature").agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    same = F.col("mn") == F.col("mx")
    params = mm.select("feature",
                       F.when(same, F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
                       F.when(same, F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi"),
                       F.lit(bins).alias("bins"))
    return _histogram_from_params(long, params)


def auto_bins(df: DataFrame, cols: list[str]) -> DataFrame:
    """Bin count per column by the 'auto' rule: the narrower of the Sturges and
    Freedman-Diaconis widths (Sturges alone when the IQR is 0). Two passes: range and
    count, then the quartiles sized by those counts."""
    long = _long(df, cols)
    mm = long.groupBy("feature").agg(F.min("value").alias("mn"), F.max("value").alias("mx"),
                                    F.count("value").alias("n")).collect()
    q = {(r["feature"], r["p"]): r["q"] for r in exact_quantiles(
        long, "value", [0.25, 0.75], ["feature"]).collect()}
    rows = []
    for r in mm:
        n, mn, mx = r["n"], r["mn"], r["mx"]
        if not n:
            continue
        iqr = q[(r["feature"], 0.75)] - q[(r["feature"], 0.25)]
        rng = mx - mn
        sturges = rng / (math.log2(n) + 1)
        fd = 2 * iqr * n ** (-1.0 / 3.0)
        width = min(fd, sturges) if iqr > 0 else sturges
        bins = int(math.ceil(rng / width)) if rng > 0 else 1
        lo, hi = (mn - 0.5, mx + 0.5) if rng == 0 else (mn, mx)
        rows.append((r["feature"], float(lo), float(hi), bins))
    return df.sparkSession.createDataFrame(rows, "feature string, lo double, hi double, bins int")


def auto_histogram(df: DataFrame, cols: list[str]) -> DataFrame:
    """Histograms with the automatic bin count, e.g. for before/after transform pairs."""
    return _histogram_from_params(_long(df, cols), auto_bins(df, cols))


REACH = 39.0  # exp(-REACH^2 / 2) is below the smallest double


def _bandwidths(long: DataFrame, gridsize: int, cut: float) -> DataFrame:
    """(feature, n, bw, g0, step) of each column's kernel and grid."""
    st = long.groupBy("feature").agg(F.count("value").cast("double").alias("n"),
                                    F.stddev_samp("value").alias("sd"),
                                    F.min("value").alias("mn"), F.max("value").alias("mx"))
    bw = F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))
    return st.select("feature", "n", bw.alias("bw"),
                     (F.col("mn") - cut * bw).alias("g0"),
                     ((F.col("mx") - F.col("mn") + 2 * cut * bw) / (gridsize - 1)).alias("step"))


def kde(df: DataFrame, cols: list[str], gridsize: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian density on a grid: Scott bandwidth n^(-1/5) * sample std, grid from
    min - cut*bw to max + cut*bw. Each distinct value adds its count-weighted kernel to the
    grid points within ``REACH`` bandwidths (beyond, the kernel is exactly 0.0); the partial
    aggregate collapses to cols x gridsize sums before the shuffle."""
    long = _long(df, cols).where(F.col("value").isNotNull())
    # kernels are added once per distinct value, weighted by its count (exact; a column
    # with few distinct values costs almost nothing)
    distinct = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("w"))
    return _densities(distinct, _bandwidths(long, gridsize, cut), gridsize)


def kde_binned(df: DataFrame, cols: list[str], gridsize: int = 200, cut: float = 3.0, error: float = 1e-4
               ) -> DataFrame:
    """``kde`` for columns of many distinct values: each value's weight is split over the two cells around
    it, and only the cells are convolved with the kernel. Splitting replaces the kernel by its linear
    interpolation over a cell of ``sqrt(8 error)`` bandwidths, so no density is off by more than
    ``error`` times the peak of one kernel, 1 / (bw sqrt(2 pi))."""
    long = _long(df, cols).where(F.col("value").isNotNull())
    params = _bandwidths(long, gridsize, cut)
    cell = (F.col("bw") * math.sqrt(8 * error)).alias("cell")
    at = (F.col("value") - F.col("g0")) / F.col("cell")
    # cols rows of parameters
    placed = long.join(F.broadcast(params.select("feature", "g0", cell)), "feature") \
        .withColumn("low", F.floor(at)).withColumn("part", at - F.col("low"))
    halves = F.explode(F.array(F.struct(F.col("low").alias("i"), (1 - F.col("part")).alias("w")),
                               F.struct((F.col("low") + 1).alias("i"), F.col("part").alias("w")))).alias("h")
    cells = (placed.select("feature", "g0", "cell", halves).groupBy("feature", "h.i")
             .agg(F.sum("h.w").alias("w"), F.first("g0").alias("g0"), F.first("cell").alias("cell"))
             .select("feature", (F.col("g0") + F.col("i") * F.col("cell")).alias("value"), "w"))
    return _densities(cells, params, gridsize)


def _densities(points: DataFrame, params: DataFrame, gridsize: int) -> DataFrame:
    """Kernel sums of weighted points (feature, value, w) at each grid point."""
    first = F.greatest(F.lit(0), F.ceil((F.col("value") - REACH * F.col("bw") - F.col("g0")) / F.col("step")))
    last = F.least(F.lit(gridsize - 1),
                   F.floor((F.col("value") + REACH * F.col("bw") - F.col("g0")) / F.col("step")))
    # cols rows; every grid point starts from one row of weight 0, so none is missing
    pts = points.join(F.broadcast(params), "feature") \
        .select("feature", "value", F.col("w").cast("double").alias("w"), "n", "bw", "g0", "step",
                F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("g"))
    pts = pts.unionByName(params.select(
        "feature", F.col("g0").alias("value"), F.lit(0.0).alias("w"), "n", "bw", "g0", "step",
        F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))).alias("g")))
    x = F.col("g0") + F.col("g") * F.col("step")
    z = (x - F.col("value")) / F.col("bw")
    sums = pts.groupBy("feature", "g").agg(F.sum(F.col("w") * F.exp(-0.5 * z * z)).alias("_s"),
                                           F.first("n").alias("n"), F.first("bw").alias("bw"),
                                           F.first("g0").alias("g0"), F.first("step").alias("step"))
    return sums.select("feature", F.col("g").cast("bigint").alias("grid_index"),
                       (F.col("g0") + F.col("g") * F.col("step")).alias("x"),
                       (F.col("_s") / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi))).alias("density"))


def boxplot_by_class(df: DataFrame, cols: list[str], label: str = "loan_status") -> DataFrame:
    """Per column x class: quartiles, whiskers (furthest points within 1.5 IQR of the
    box), outliers beyond them, count."""
    long = _long(df, cols, [label]).withColumnRenamed(label, "class") \
        .where(F.col("value").isNotNull())
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], ["feature", "class"])
    qw = q.groupBy("feature", "class").agg(
        F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q1"),
        F.max(F.when(F.col("p") == 0.5, F.col("q"))).alias("median"),
        F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q3"))
    v = F.col("value")
    lo_f = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi_f = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    # the lower whisker is the smallest value at or above the lower fence, so "below the
    # whisker" is "below the fence": outliers are counted in the same pass
    agg = long.join(F.broadcast(qw), ["feature", "class"]).groupBy("feature", "class").agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(v >= lo_f, v)).alias("whisker_lo"),
        F.max(F.when(v <= hi_f, v)).alias("whisker_hi"),
        F.sum(F.when((v < lo_f) | (v > hi_f), 1).otherwise(0)).cast("bigint").alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))
    return agg.select("feature", F.col("class").cast("bigint").alias("class"), "q1", "median", "q3",
                      "whisker_lo", "whisker_hi", "n_outliers", "n")


# ---------------------------------------------------------------- categorical vs label
def crosstab_counts(df: DataFrame, cols: list[str], label: str = "loan_status") -> DataFrame:
    """(column, category, n0, n1) for every categorical column in one shuffle; NULL
    categories dropped."""
    long = _long(df, cols, [label], cast="string").where(F.col("value").isNotNull())
    y = F.col(label)
    return long.groupBy("feature", F.col("value").alias("category")).agg(
        F.sum(F.when(y == 0, 1).otherwise(0)).cast("bigint").alias("n0"),
        F.sum(F.when(y == 1, 1).otherwise(0)).cast("bigint").alias("n1"))


def crosstab_row_pct(df: DataFrame, cols: list[str], label: str = "loan_status") -> DataFrame:
    ct = crosstab_counts(df, cols, label)
    tot = (F.col("n0") + F.col("n1")).cast("double")
    return ct.select("feature", "category", (100.0 * F.col("n0") / tot).alias("pct0"),
                     (100.0 * F.col("n1") / tot).alias("pct1"))


def chi_square(df: DataFrame, cols: list[str], label: str = "loan_status",
               correction: bool = True) -> DataFrame:
    """Pearson chi-square of each categorical column against the label; Yates'
    correction when dof = 1 (S8). p from the chi-square tail on one row per column."""
    long = _long(df, cols, [label], cast="string").where(
        F.col("value").isNotNull() & F.col(label).isNotNull())
    obs = long.groupBy("feature", F.col("value").alias("category"),
                       F.col(label).cast("string").alias("cls")).agg(F.count(F.lit(1)).alias("o"))
    # every (category, class) cell, zero cells included
    cats = obs.select("feature", "category").distinct()
    classes = obs.select("feature", "cls").distinct()
    cells = cats.join(classes, "feature").join(obs, ["feature", "category", "cls"], "left") \
        .fillna(0, ["o"])
    rt = obs.groupBy("feature", "category").agg(F.sum("o").alias("rt"))
    ctot = obs.groupBy("feature", "cls").agg(F.sum("o").alias("ct"))
    nt = obs.groupBy("feature").agg(F.sum("o").alias("nt"),
                                   F.count_distinct("category").alias("r"),
                                   F.count_distinct("cls").alias("c"))
    e = F.col("rt") * F.col("ct") / F.col("nt")
    d = F.abs(F.col("o") - e)
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    adj = F.when((dof == 1) & F.lit(correction), d - F.least(F.lit(0.5), d)).otherwise(d)
    terms = cells.join(rt, ["feature", "category"]).join(ctot, ["feature", "cls"]).join(nt, "feature")
    stat = terms.groupBy("feature").agg(F.sum(adj * adj / e).alias("chi2"),
                                       F.first(dof).cast("bigint").alias("dof"))
    return stat.select("feature", "chi2", "dof", chi2_p("chi2", "dof").alias("p"))


def mann_whitney_u(df: DataFrame, cols: list[str], label: str = "loan_status") -> DataFrame:
    """U of class 0 per column with average ranks for ties; two-sided p from the normal
    approximation with tie and continuity correction.

    Rows collapse to distinct (column, value) counts; mid-ranks need the count of
    smaller values, a running sum done by bucketed prefix sums."""
    long = _long(df, cols, [label]).where(F.col("value").isNotNull() & F.col(label).isNotNull())
    per = long.groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("t"),
        F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("t0"))
    ranked = prefix_sums(per, ["value"], ["t"], ["feature"])
    mid = F.col("t_before") + (F.col("t") + 1) / 2.0
    s = ranked.groupBy("feature").agg(
        F.sum(F.col("t0") * mid).alias("r0"), F.sum("t").cast("double").alias("n"),
        F.sum("t0").cast("double").alias("n0"),
        F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"))
    n, n0 = F.col("n"), F.col("n0")
    n1 = n - n0
    u0 = F.col("r0") - n0 * (n0 + 1) / 2
    mu = n0 * n1 / 2
    sigma = F.sqrt(n0 * n1 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    u = F.greatest(u0, n0 * n1 - u0)
    z = F.try_divide(u - mu - 0.5, sigma)
    return s.select("feature", u0.alias("u"), normal_two_sided_p(z).alias("p"))


def significance_flag(tests: DataFrame, alpha: float = 0.05, p_col: str = "p") -> DataFrame:
    return tests.withColumn("significant", (F.col(p_col) < alpha).cast("int"))


def mutual_info(df: DataFrame, cols: list[str], label: str = "loan_status",
                bins: int | None = None) -> DataFrame:
    """Mutual information (natural log) of each column with the label. Categorical
    columns use their values; with ``bins`` numeric columns are first cut into
    equal-width bins (a binned estimator)."""
    if bins:
        long = _long(df, cols, [label]).where(F.col("value").isNotNull())
        mm = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
        params = mm.select("feature", "lo", F.when(F.col("hi") > F.col("lo"), F.col("hi"))
                           .otherwise(F.col("lo") + 1).alias("hi"), F.lit(bins).alias("bins"))
        j = long.join(F.broadcast(params), "feature")
        width = (F.col("hi") - F.col("lo")) / F.col("bins")
        xb = F.least(F.col("bins") - 1, F.floor((F.col("value") - F.col("lo")) / width)).cast("string")
        pts = j.select("feature", xb.alias("x"), F.col(label).alias("y"))
    else:
        pts = _long(df, cols, [label], cast="string").where(F.col("value").isNotNull()) \
            .select("feature", F.col("value").alias("x"), F.col(label).alias("y"))
    pts = pts.where(F.col("y").isNotNull())
    nxy = pts.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("nxy"))
    nx = nxy.groupBy("feature", "x").agg(F.sum("nxy").alias("nx"))
    ny = nxy.groupBy("feature", "y").agg(F.sum("nxy").alias("ny"))
    nn = nxy.groupBy("feature").agg(F.sum("nxy").alias("n"))
    t = nxy.join(nx, ["feature", "x"]).join(ny, ["feature", "y"]).join(nn, "feature")
    term = (F.col("nxy") / F.col("n")) * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    return t.groupBy("feature").agg(F.sum(term).alias("mi"))
