"""Projections, filters and scalar features.

All are column expressions inside one ``select`` (whole-stage codegen); the only
data-dependent parameters are medians, fitted once by exact selection and then
applied as literals, so predict reuses the fit's medians (parity flag available).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credora.functions.ieee import ieee_divide, ieee_log1p, ieee_sqrt
from credora.operators.quantile import wide_quantiles

# The reference's bin edges (right-closed) and feature lists.
AGE_EDGES = [0, 25, 35, 45, 100]
INCOME_EDGES = [0, 30000, 60000, 100000, float("inf")]
FULL_LOG_COLS = ["person_income", "interest_to_income_ratio", "debt_to_income_ratio",
                 "eff_cost_borrowing", "cred_hist_x_income"]
FULL_SQRT_COLS = ["person_emp_length", "loan_amnt", "cb_person_cred_hist_length",
                  "cred_hist_x_int_rate"]
EDA_LOG_COLS = ["person_income", "interest_to_income_ratio", "debt_to_income_ratio"]
EDA_SQRT_COLS = ["person_emp_length", "loan_amnt", "cb_person_cred_hist_length"]
EDA_MODEL_NUMERIC = ["person_income_log", "person_emp_length_sqrt", "loan_amnt_sqrt",
                     "loan_int_rate", "loan_percent_income", "cb_person_cred_hist_length_sqrt",
                     "interest_to_income_ratio_log", "debt_to_income_ratio_log"]


def _with(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Replace or append columns in one projection, keeping order."""
    keep = [F.col(f"`{c}`") if c not in new else new[c].alias(c) for c in df.columns]
    return df.select(*keep, *[v.alias(k) for k, v in new.items() if k not in df.columns])


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    out = df.drop(*[c for c in cols if c in df.columns])
    assert not set(cols) & set(out.columns), "columns still present after drop"
    return out


def filter_class(df: DataFrame, label: str, cls, col: str | None = None) -> DataFrame:
    cond = F.col(label) == F.lit(cls)
    if col is not None:
        cond = cond & F.col(col).isNotNull()
    return df.where(cond)


def fit_medians(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Exact medians (linear interpolation, nulls skipped) in one distributed selection."""
    return {c: q for (c, _), q in wide_quantiles(df, cols, [0.5]).items()}


def impute_median(df: DataFrame, cols: list[str], medians: dict[str, float] | None = None
                  ) -> DataFrame:
    """Fill nulls with the median. ``medians=None`` computes them on ``df`` itself (the
    reference's per-frame behaviour, Q1); pass fitted medians to reuse the training ones."""
    med = medians if medians is not None else fit_medians(df, cols)
    return _with(df, {c: F.coalesce(F.col(c), F.lit(med[c]).cast("double")) if med.get(c) is not None
                      else F.col(c) for c in cols})


def ratio_raw(df: DataFrame, num: str, den: str, name: str) -> DataFrame:
    return _with(df, {name: ieee_divide(num, den)})


def ratio_plus_one(df: DataFrame, num: str, den: str, name: str) -> DataFrame:
    return _with(df, {name: ieee_divide(F.col(num), F.col(den).cast("double") + 1)})


def ratio_hist_age(df: DataFrame, hist: str = "cb_person_cred_hist_length",
                   age: str = "person_age", name: str = "credit_hist_to_age") -> DataFrame:
    return _with(df, {name: ieee_divide(hist, age)})


def products(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """``{name: (a, b)}`` -> a * b in double (no ANSI integer overflow)."""
    return _with(df, {n: F.col(a).cast("double") * F.col(b).cast("double")
                      for n, (a, b) in pairs.items()})


def log1p_columns(df: DataFrame, cols: list[str], suffix: str = "_log") -> DataFrame:
    return _with(df, {f"{c}{suffix}": ieee_log1p(c) for c in cols if c in df.columns})


def sqrt_columns(df: DataFrame, cols: list[str], suffix: str = "_sqrt") -> DataFrame:
    return _with(df, {f"{c}{suffix}": ieee_sqrt(c) for c in cols if c in df.columns})


def flag_at_least(df: DataFrame, col: str, k: float, name: str) -> DataFrame:
    """``x >= k`` as 0/1; NULL compares false (S13)."""
    return _with(df, {name: F.coalesce(F.col(col) >= F.lit(k), F.lit(False)).cast("int")})


def flag_above_median(df: DataFrame, col: str, name: str, median: float | None = None
                      ) -> DataFrame:
    """``x > median(x)`` strictly, as 0/1."""
    m = median if median is not None else fit_medians(df, [col])[col]
    return _with(df, {name: F.coalesce(F.col(col) > F.lit(m), F.lit(False)).cast("int")})


def bin_code_expr(col: str, edges: list[float]) -> Column:
    """Right-closed bins (e0, e1], (e1, e2], ... -> 0, 1, ...; outside or NULL -> -1."""
    x = F.col(col)
    expr = F.lit(-1)
    for i in reversed(range(len(edges) - 1)):
        lo, hi = edges[i], edges[i + 1]
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(i)).otherwise(expr)
    return expr.cast("int")


def bin_codes(df: DataFrame, col: str, edges: list[float], name: str) -> DataFrame:
    return _with(df, {name: bin_code_expr(col, edges)})


def align_columns(df: DataFrame, feature_cols: list[str]) -> DataFrame:
    """Frozen feature list: missing columns become 0, extras are dropped, order fixed."""
    present = set(df.columns)
    return df.select(*[F.col(f"`{c}`") if c in present else F.lit(0).alias(c) for c in feature_cols])


def select_features(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in cols])


def threshold_predictions(df: DataFrame, score: str, threshold: float = 0.5,
                          name: str = "prediction") -> DataFrame:
    """score strictly above the threshold -> 1."""
    return _with(df, {name: (F.col(score) > F.lit(threshold)).cast("int")})


def engineer_basic(df: DataFrame, medians: dict[str, float] | None = None) -> DataFrame:
    """Ratios, stability / high-interest flags and right-closed age / income bins.

    Two passes: medians (emp length, interest rate), then one projection.
    """
    need = [c for c in ("person_emp_length", "loan_int_rate") if c in df.columns]
    med = medians if medians is not None else fit_medians(df, need)
    emp = F.coalesce(F.col("person_emp_length"), F.lit(med["person_emp_length"]))
    out = _with(df, {"person_emp_length": emp})
    return _with(out, {
        "debt_to_income": ieee_divide(F.col("loan_amnt"), F.col("person_income").cast("double") + 1),
        "income_per_year_employed": ieee_divide(F.col("person_income"),
                                                F.col("person_emp_length") + 1),
        "credit_hist_to_age": ieee_divide("cb_person_cred_hist_length", "person_age"),
        "employment_stable": F.coalesce(F.col("person_emp_length") >= 5, F.lit(False)).cast("int"),
        "high_interest": F.coalesce(F.col("loan_int_rate") > F.lit(med["loan_int_rate"]),
                                    F.lit(False)).cast("int"),
        "age_group": bin_code_expr("person_age", AGE_EDGES),
        "income_bracket": bin_code_expr("person_income", INCOME_EDGES),
    })


def engineer_full(df: DataFrame, medians: dict[str, float] | None = None) -> DataFrame:
    """Drop age; impute; ratios, products, log1p / sqrt transforms, flags."""
    need = [c for c in ("person_emp_length", "loan_int_rate") if c in df.columns]
    med = medians if medians is not None else fit_medians(df, need)
    out = drop_columns(df, ["person_age"])
    out = _with(out, {"person_emp_length": F.coalesce(F.col("person_emp_length"),
                                                      F.lit(med["person_emp_length"]))})
    inc1 = F.col("person_income").cast("double") + 1
    out = _with(out, {
        "debt_to_income_ratio": ieee_divide(F.col("loan_amnt"), inc1),
        "interest_to_income_ratio": ieee_divide(F.col("loan_int_rate"), inc1),
        "eff_cost_borrowing": F.col("loan_amnt") * F.col("loan_int_rate"),
        "cred_hist_x_int_rate": F.col("cb_person_cred_hist_length") * F.col("loan_int_rate"),
        "cred_hist_x_income": F.col("cb_person_cred_hist_length")
        * F.col("person_income").cast("double"),
    })
    out = log1p_columns(out, FULL_LOG_COLS)
    out = sqrt_columns(out, FULL_SQRT_COLS)
    return _with(out, {
        "employment_stable": F.coalesce(F.col("person_emp_length") >= 5, F.lit(False)).cast("int"),
        "high_interest": F.coalesce(F.col("loan_int_rate") > F.lit(med["loan_int_rate"]),
                                    F.lit(False)).cast("int"),
    })


def engineer_eda(df: DataFrame, categories: dict[str, list[str]] | None = None,
                 categorical: list[str] | None = None) -> DataFrame:
    """The exploration hand-over table: drop-first dummies (aligned to ``categories``),
    drop age, raw ratios, log1p and sqrt transforms."""
    from credora.operators.encode import fit_categories, one_hot_drop_first

    cats = categorical or [c for c in ("person_home_ownership", "loan_intent", "loan_grade",
                                       "cb_person_default_on_file") if c in df.columns]
    levels = categories if categories is not None else fit_categories(df, cats)
    out = one_hot_drop_first(df, cats, levels)
    out = drop_columns(out, ["person_age"])
    out = _with(out, {
        "interest_to_income_ratio": ieee_divide("loan_int_rate", "person_income"),
        "debt_to_income_ratio": ieee_divide("loan_amnt", "person_income"),
    })
    out = log1p_columns(out, EDA_LOG_COLS)
    return sqrt_columns(out, EDA_SQRT_COLS)
