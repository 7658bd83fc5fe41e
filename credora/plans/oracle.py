"""DuckDB oracle SQL for the registered queries (independent definitions, same
semantics). Computed doubles are rounded to 6 digits as on the Spark side."""

from __future__ import annotations

from credora.operators.features import AGE_EDGES, INCOME_EDGES
from credora.operators.metrics import F1_SWEEP
from credora.plans.queries import ALIGN_TO, AUTO_HIST_COLS, CATEGORICAL, NUMERIC
from credora.sources.loans import LOANS_SQL, SCORES_SQL

# Category levels of the loans table (sorted), used by the dummy SQL.
LEVELS = {
    "person_home_ownership": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "loan_intent": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "loan_grade": ["A", "B", "C", "D", "E"],
    "cb_person_default_on_file": ["N", "Y"],
}
LOAN_COLS = ["id", "person_age", "person_income", "person_home_ownership", "person_emp_length",
             "loan_intent", "loan_grade", "loan_amnt", "loan_int_rate", "loan_percent_income",
             "cb_person_default_on_file", "cb_person_cred_hist_length", "loan_status"]
LOAN_TYPES = ["bigint", "bigint", "bigint", "string", "double", "string", "string", "double",
              "double", "double", "string", "double", "bigint"]
LOAN_DOUBLES = [c for c, t in zip(LOAN_COLS, LOAN_TYPES) if t == "double"]

PRELUDE = f"WITH loans AS ({LOANS_SQL}), scored AS ({SCORES_SQL})"

SQL: dict[str, str] = {}


def q(s: str) -> str:
    return '"' + s.replace('"', '""') + '"'


def oracle(name: str, body: str, dbl: list[str] | None = None):
    """Register ``body`` (may define extra CTEs with a leading comma) rounding ``dbl``."""
    dbl = dbl or []
    if body.lstrip().startswith(","):
        head, sel = body.split("\n#SELECT\n")
        full = f"{PRELUDE}{head}\n{sel}"
    else:
        full = f"{PRELUDE}\n{body}"
    if dbl:
        rep = ", ".join(f"round({q(c)}, 6) AS {q(c)}" for c in dbl)
        full = f"SELECT * REPLACE ({rep}) FROM ({full}) _o"
    SQL[name] = full


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def ln1p(x: str) -> str:
    return f"ln(1 + ({x}))"


def ieee_div(a: str, b: str) -> str:
    return (f"CASE WHEN ({b}) <> 0 THEN CAST({a} AS DOUBLE) / ({b}) WHEN ({a}) IS NULL OR ({b}) IS NULL "
            f"THEN NULL WHEN ({a}) = 0 THEN 'nan'::DOUBLE WHEN ({a}) > 0 THEN 'inf'::DOUBLE "
            f"ELSE '-inf'::DOUBLE END")


def dummies_drop_first(cols) -> list[str]:
    return [f"CAST(coalesce({c} = '{v}', false) AS INTEGER) AS {q(f'{c}_{v}')}"
            for c in cols for v in LEVELS[c][1:]]


def bins(col: str, edges) -> str:
    parts = []
    for i in range(len(edges) - 1):
        hi = "'inf'::DOUBLE" if edges[i + 1] == float("inf") else str(edges[i + 1])
        parts.append(f"WHEN {col} > {edges[i]} AND {col} <= {hi} THEN {i}")
    return f"CAST(CASE {' '.join(parts)} ELSE -1 END AS INTEGER)"


MED = "(SELECT quantile_cont({c}, 0.5) FROM loans)"
EDA_DUMMIES = [f"{c}_{v}" for c in CATEGORICAL for v in LEVELS[c][1:]]
EDA_SQL = f"""SELECT * EXCLUDE (person_age),
  {', '.join(dummies_drop_first(CATEGORICAL))},
  {ieee_div('loan_int_rate', 'person_income')} AS interest_to_income_ratio,
  {ieee_div('loan_amnt', 'person_income')} AS debt_to_income_ratio,
  {ln1p('person_income')} AS person_income_log,
  {ln1p(ieee_div('loan_int_rate', 'person_income'))} AS interest_to_income_ratio_log,
  {ln1p(ieee_div('loan_amnt', 'person_income'))} AS debt_to_income_ratio_log,
  sqrt(person_emp_length) AS person_emp_length_sqrt, sqrt(loan_amnt) AS loan_amnt_sqrt,
  sqrt(cb_person_cred_hist_length) AS cb_person_cred_hist_length_sqrt
FROM loans"""
EDA_DOUBLES = LOAN_DOUBLES + ["interest_to_income_ratio", "debt_to_income_ratio",
                              "person_income_log", "interest_to_income_ratio_log",
                              "debt_to_income_ratio_log", "person_emp_length_sqrt",
                              "loan_amnt_sqrt", "cb_person_cred_hist_length_sqrt"]
PRED = "SELECT *, CAST(score_a > 0.5 AS INTEGER) AS prediction FROM scored"

# ------------------------------------------------------------------ sources / sinks
oracle("read_table", "SELECT * FROM customer", ["c_acctbal"])
oracle("read_csv", "SELECT c_custkey, CASE WHEN c_custkey % 7 > 1 THEN c_acctbal END AS c_acctbal, "
       "CASE WHEN c_custkey % 11 > 0 THEN c_mktsegment END AS c_mktsegment, "
       "CASE WHEN c_custkey % 5 > 0 THEN CAST(c_nationkey AS BIGINT) END AS c_nationkey FROM customer", ["c_acctbal"])
oracle("write_processed", EDA_SQL, EDA_DOUBLES)
oracle("write_predictions", "SELECT id, CAST(score_a > 0.5 AS BIGINT) AS loan_status FROM scored")

# ------------------------------------------------------------------ profiling
oracle("table_shape", f"SELECT count(*) AS n_rows, CAST({len(LOAN_COLS)} AS BIGINT) AS n_cols FROM loans")
oracle("column_info", union([
    f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS feature, '{t}' AS dtype, count({c}) AS non_null FROM loans"
    for i, (c, t) in enumerate(zip(LOAN_COLS, LOAN_TYPES))]))
oracle("null_counts", "SELECT * FROM (" + union([
    f"SELECT '{c}' AS feature, CAST(count(*) - count({c}) AS BIGINT) AS nulls FROM loans"
    for c in LOAN_COLS]) + ") WHERE nulls > 0")
oracle("describe", union([
    f"SELECT '{c}' AS feature, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, "
    f"CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, "
    f"quantile_cont({c}, 0.75) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM loans" for c in NUMERIC]),
    ["mean", "std", "min", "q25", "q50", "q75", "max"])
oracle("preview", "SELECT * FROM loans ORDER BY id LIMIT 5", LOAN_DOUBLES)
oracle("value_counts", "SELECT loan_intent AS value, count(*) AS count, "
       "count(*) / sum(count(*)) OVER () AS share FROM loans WHERE loan_intent IS NOT NULL "
       "GROUP BY loan_intent", ["share"])
oracle("class_counts", "SELECT CAST(c.class AS BIGINT) AS class, CAST(coalesce(n, 0) AS BIGINT) AS count FROM "
       "(VALUES (0), (1)) c(class) LEFT JOIN (SELECT loan_status AS class, count(*) AS n FROM loans "
       "GROUP BY 1) x ON CAST(c.class AS BIGINT) = x.class")
oracle("imbalance_ratio", "SELECT CAST(sum(CASE WHEN loan_status = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n0, "
       "CAST(sum(CASE WHEN loan_status = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n1, "
       "sum(CASE WHEN loan_status = 0 THEN 1 ELSE 0 END) / sum(CASE WHEN loan_status = 1 THEN 1 ELSE 0 END) "
       "AS ratio FROM loans", ["ratio"])
oracle("class_shares_and_weight", "SELECT s0 AS share0, s1 AS share1, s0 / s1 AS pos_weight FROM ("
       "SELECT avg(CASE WHEN loan_status = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS s0, "
       "avg(CASE WHEN loan_status = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS s1 FROM loans)",
       ["share0", "share1", "pos_weight"])
oracle("distinct_values", union([f"SELECT DISTINCT '{c}' AS feature, {c} AS value FROM loans "
                                 f"WHERE {c} IS NOT NULL" for c in CATEGORICAL]))
oracle("feature_stats", "SELECT min(mn) AS min, max(mx) AS max, avg(m) AS mean, avg(s) AS std FROM (" + union([
    f"SELECT CAST(min({c}) AS DOUBLE) AS mn, CAST(max({c}) AS DOUBLE) AS mx, avg({c}) AS m, "
    f"stddev_pop({c}) AS s FROM loans" for c in NUMERIC]) + ")", ["min", "max", "mean", "std"])
_QC = f"SELECT loan_amnt, person_emp_length, {ieee_div('loan_amnt', 'person_emp_length')} AS amnt_per_emp_year FROM loans"
_qc_parts = [
    f"SELECT '{c}' AS feature, CAST(sum(CASE WHEN isnan({c}) THEN 1 ELSE 0 END) AS BIGINT) AS nan_count, "
    f"CAST(sum(CASE WHEN abs({c}) = 'inf'::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS inf_count, "
    f"min(CASE WHEN NOT isnan({c}) AND abs({c}) <> 'inf'::DOUBLE THEN {c} END) AS min, "
    f"max(CASE WHEN NOT isnan({c}) AND abs({c}) <> 'inf'::DOUBLE THEN {c} END) AS max FROM qc"
    for c in ["loan_amnt", "person_emp_length", "amnt_per_emp_year"]]
oracle("quality_check", f""", qc AS ({_QC}), per AS ({union(_qc_parts)})
#SELECT
SELECT * FROM per UNION ALL SELECT '__all__', CAST(sum(nan_count) AS BIGINT), CAST(sum(inf_count) AS BIGINT),
  min(min), max(max) FROM per""", ["min", "max"])

# ------------------------------------------------------------------ projections / features
oracle("drop_columns", "SELECT * EXCLUDE (person_age) FROM loans", LOAN_DOUBLES)
oracle("filter_class", "SELECT * FROM loans WHERE loan_status = 1 AND person_emp_length IS NOT NULL",
       LOAN_DOUBLES)
oracle("impute_median", "SELECT id, coalesce(person_emp_length, "
       + MED.format(c="person_emp_length") + ") AS person_emp_length FROM loans", ["person_emp_length"])
oracle("ratio_raw", f"SELECT id, {ieee_div('loan_amnt', 'person_income')} AS debt_to_income_ratio, "
       f"{ieee_div('loan_int_rate', 'person_income')} AS interest_to_income_ratio FROM loans",
       ["debt_to_income_ratio", "interest_to_income_ratio"])
oracle("ratio_plus_one", f"SELECT id, {ieee_div('loan_amnt', 'CAST(person_income AS DOUBLE) + 1')} AS debt_to_income, "
       f"{ieee_div('loan_int_rate', 'CAST(person_income AS DOUBLE) + 1')} AS interest_to_income_ratio, "
       f"{ieee_div('person_income', 'person_emp_length + 1')} AS income_per_year_employed FROM loans",
       ["debt_to_income", "interest_to_income_ratio", "income_per_year_employed"])
oracle("ratio_hist_age", f"SELECT id, {ieee_div('cb_person_cred_hist_length', 'person_age')} AS credit_hist_to_age "
       "FROM loans", ["credit_hist_to_age"])
oracle("products", "SELECT id, loan_amnt * loan_int_rate AS eff_cost_borrowing, "
       "cb_person_cred_hist_length * loan_int_rate AS cred_hist_x_int_rate, "
       "cb_person_cred_hist_length * CAST(person_income AS DOUBLE) AS cred_hist_x_income FROM loans",
       ["eff_cost_borrowing", "cred_hist_x_int_rate", "cred_hist_x_income"])
oracle("log1p_columns", "SELECT id, " + ", ".join(
    f"{ln1p(c)} AS {c}_log" for c in ["person_income", "loan_amnt", "loan_percent_income"]) + " FROM loans",
    ["person_income_log", "loan_amnt_log", "loan_percent_income_log"])
oracle("sqrt_columns", "SELECT id, " + ", ".join(
    f"sqrt({c}) AS {c}_sqrt" for c in ["person_emp_length", "loan_amnt", "cb_person_cred_hist_length"])
    + " FROM loans", ["person_emp_length_sqrt", "loan_amnt_sqrt", "cb_person_cred_hist_length_sqrt"])
oracle("flag_at_least", "SELECT id, CAST(coalesce(person_emp_length >= 5, false) AS INTEGER) AS employment_stable "
       "FROM loans")
oracle("flag_above_median", "SELECT id, CAST(coalesce(loan_int_rate > " + MED.format(c="loan_int_rate")
       + ", false) AS INTEGER) AS high_interest FROM loans")
oracle("bin_codes", f"SELECT id, {bins('person_age', AGE_EDGES)} AS age_group, "
       f"{bins('person_income', INCOME_EDGES)} AS income_bracket FROM loans")
_ONE_HOT_FULL = ", ".join(f"CAST(coalesce({c} = '{v}', false) AS INTEGER) AS {q(f'{p}_{v}')}"
                          for c, p in zip(["person_home_ownership", "loan_intent", "loan_grade"],
                                          ["home", "intent", "grade"]) for v in LEVELS[c])
oracle("align_columns", f", oh AS (SELECT * EXCLUDE (person_home_ownership, loan_intent, loan_grade), "
       f"{_ONE_HOT_FULL} FROM loans)\n#SELECT\nSELECT " + ", ".join(
           q(c) if c != "home_OTHER" else f"0 AS {q(c)}" for c in ALIGN_TO) + " FROM oh", ["loan_amnt"])
from credora.operators.features import EDA_MODEL_NUMERIC  # noqa: E402
oracle("select_features", f", eda AS ({EDA_SQL})\n#SELECT\nSELECT id, " + ", ".join(
    q(c) for c in EDA_MODEL_NUMERIC + EDA_DUMMIES) + " FROM eda",
    [c for c in EDA_MODEL_NUMERIC])
_BASIC_MED = {c: MED.format(c=c) for c in ("person_emp_length", "loan_int_rate")}
oracle("engineer_basic", f""", b AS (SELECT * REPLACE (coalesce(person_emp_length, {_BASIC_MED['person_emp_length']}) AS person_emp_length) FROM loans)
#SELECT
SELECT *, {ieee_div('loan_amnt', 'CAST(person_income AS DOUBLE) + 1')} AS debt_to_income,
  {ieee_div('person_income', 'person_emp_length + 1')} AS income_per_year_employed,
  {ieee_div('cb_person_cred_hist_length', 'person_age')} AS credit_hist_to_age,
  CAST(coalesce(person_emp_length >= 5, false) AS INTEGER) AS employment_stable,
  CAST(coalesce(loan_int_rate > {_BASIC_MED['loan_int_rate']}, false) AS INTEGER) AS high_interest,
  {bins('person_age', AGE_EDGES)} AS age_group, {bins('person_income', INCOME_EDGES)} AS income_bracket
FROM b""", LOAN_DOUBLES + ["debt_to_income", "income_per_year_employed", "credit_hist_to_age"])
_FULL_DOUBLES = [c for c in LOAN_DOUBLES] + [
    "debt_to_income_ratio", "interest_to_income_ratio", "eff_cost_borrowing", "cred_hist_x_int_rate",
    "cred_hist_x_income", "person_income_log", "interest_to_income_ratio_log", "debt_to_income_ratio_log",
    "eff_cost_borrowing_log", "cred_hist_x_income_log", "person_emp_length_sqrt", "loan_amnt_sqrt",
    "cb_person_cred_hist_length_sqrt", "cred_hist_x_int_rate_sqrt"]
oracle("engineer_full", f""", b AS (SELECT * EXCLUDE (person_age) REPLACE (coalesce(person_emp_length, {_BASIC_MED['person_emp_length']}) AS person_emp_length) FROM loans),
c AS (SELECT *, {ieee_div('loan_amnt', 'CAST(person_income AS DOUBLE) + 1')} AS debt_to_income_ratio,
  {ieee_div('loan_int_rate', 'CAST(person_income AS DOUBLE) + 1')} AS interest_to_income_ratio,
  loan_amnt * loan_int_rate AS eff_cost_borrowing,
  cb_person_cred_hist_length * loan_int_rate AS cred_hist_x_int_rate,
  cb_person_cred_hist_length * CAST(person_income AS DOUBLE) AS cred_hist_x_income FROM b)
#SELECT
SELECT *, {ln1p('person_income')} AS person_income_log, {ln1p('interest_to_income_ratio')} AS interest_to_income_ratio_log,
  {ln1p('debt_to_income_ratio')} AS debt_to_income_ratio_log, {ln1p('eff_cost_borrowing')} AS eff_cost_borrowing_log,
  {ln1p('cred_hist_x_income')} AS cred_hist_x_income_log, sqrt(person_emp_length) AS person_emp_length_sqrt,
  sqrt(loan_amnt) AS loan_amnt_sqrt, sqrt(cb_person_cred_hist_length) AS cb_person_cred_hist_length_sqrt,
  sqrt(cred_hist_x_int_rate) AS cred_hist_x_int_rate_sqrt,
  CAST(coalesce(person_emp_length >= 5, false) AS INTEGER) AS employment_stable,
  CAST(coalesce(loan_int_rate > {_BASIC_MED['loan_int_rate']}, false) AS INTEGER) AS high_interest
FROM c""", _FULL_DOUBLES)
oracle("engineer_eda", EDA_SQL, EDA_DOUBLES)
oracle("threshold_predictions", "SELECT id, CAST(score_a > 0.5 AS INTEGER) AS prediction FROM scored")

# ------------------------------------------------------------------ encoding / scaling
oracle("label_encode", "SELECT id, " + ", ".join(
    f"CAST((SELECT count(DISTINCT l2.{c}) FROM loans l2 WHERE l2.{c} < l.{c}) AS INTEGER) AS {c}_encoded"
    for c in CATEGORICAL) + " FROM loans l")
oracle("one_hot_full", "SELECT * EXCLUDE (person_home_ownership, loan_intent, loan_grade), "
       + _ONE_HOT_FULL + " FROM loans", [c for c in LOAN_DOUBLES])
oracle("one_hot_drop_first", "SELECT *, " + ", ".join(dummies_drop_first(CATEGORICAL)) + " FROM loans",
       LOAN_DOUBLES)
_RS = ", ".join(
    f"(CAST({c} AS DOUBLE) - quantile_cont({c}, 0.5)) / CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) = 0 "
    f"THEN 1 ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END AS p_{c}" for c in NUMERIC)
oracle("robust_scale", f""", p AS (SELECT {', '.join(
    f"quantile_cont({c}, 0.5) AS m_{c}, CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) = 0 THEN 1 "
    f"ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END AS s_{c}" for c in NUMERIC)} FROM loans)
#SELECT
SELECT id, {', '.join(f"(CAST({c} AS DOUBLE) - m_{c}) / s_{c} AS {c}" for c in NUMERIC)} FROM loans, p""", NUMERIC)
oracle("standard_scale", f""", p AS (SELECT {', '.join(
    f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in NUMERIC)} FROM loans)
#SELECT
SELECT id, {', '.join(f"(CAST({c} AS DOUBLE) - m_{c}) / s_{c} AS {c}" for c in NUMERIC)} FROM loans, p""", NUMERIC)

# ------------------------------------------------------------------ statistics
_CM = NUMERIC + ["loan_status"]
_pairs = []
for _i, _a in enumerate(_CM):
    for _j, _b in enumerate(_CM):
        r = "CASE WHEN stddev_pop({a}) > 0 THEN 1.0 END".format(a=_a) if _a == _b else f"corr({_a}, {_b})"
        _pairs.append(f"SELECT '{_a}' AS col_a, '{_b}' AS col_b, {r} AS r FROM loans")
oracle("corr_matrix", union(_pairs), ["r"])
oracle("corr_with_label", union([f"SELECT '{c}' AS feature, corr({c}, loan_status) AS r FROM loans"
                                 for c in NUMERIC]), ["r"])
oracle("skew_table", union([f"SELECT '{c}' AS feature, skewness({c}) AS skew FROM loans" for c in NUMERIC]),
       ["skew"])
_LONG = union([f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, loan_status FROM loans" for c in NUMERIC])
oracle("histogram", f""", lg AS ({_LONG}), mm AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM lg GROUP BY 1),
cnt AS (SELECT lg.feature, CAST(least(49, floor((value - lo) / ((hi - lo) / 50))) AS INTEGER) AS bin, count(*) AS c
        FROM lg JOIN mm USING (feature) WHERE value IS NOT NULL GROUP BY 1, 2)
#SELECT
SELECT mm.feature, 50 AS n_bins, CAST(g.range AS INTEGER) AS bin, lo + g.range * ((hi - lo) / 50) AS edge_lo,
  lo + (g.range + 1) * ((hi - lo) / 50) AS edge_hi, CAST(coalesce(c, 0) AS BIGINT) AS count
FROM mm, range(50) g LEFT JOIN cnt ON cnt.feature = mm.feature AND cnt.bin = g.range""", ["edge_lo", "edge_hi"])
_AH = union([f"SELECT '{c}' AS feature, CAST({q(c)} AS DOUBLE) AS value FROM eda" for c in AUTO_HIST_COLS])
oracle("auto_histogram", f""", eda AS ({EDA_SQL}), lg AS ({_AH}),
st AS (SELECT feature, min(value) AS lo, max(value) AS hi, CAST(count(value) AS DOUBLE) AS n,
       quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM lg GROUP BY 1),
pr AS (SELECT feature, lo, hi, CAST(CASE WHEN hi > lo THEN ceil((hi - lo) / (CASE WHEN iqr > 0 THEN
        least(2 * iqr * pow(n, -1.0 / 3.0), (hi - lo) / (log2(n) + 1)) ELSE (hi - lo) / (log2(n) + 1) END)) ELSE 1 END
        AS INTEGER) AS bins FROM st),
cnt AS (SELECT lg.feature, CAST(least(bins - 1, floor((value - lo) / ((hi - lo) / bins))) AS INTEGER) AS bin,
        count(*) AS c FROM lg JOIN pr USING (feature) WHERE value IS NOT NULL GROUP BY 1, 2)
#SELECT
SELECT pr.feature, bins AS n_bins, CAST(g.bin AS INTEGER) AS bin, lo + g.bin * ((hi - lo) / bins) AS edge_lo,
  lo + (g.bin + 1) * ((hi - lo) / bins) AS edge_hi, CAST(coalesce(c, 0) AS BIGINT) AS count
FROM pr, LATERAL (SELECT unnest(range(0, pr.bins)) AS bin) g
LEFT JOIN cnt ON cnt.feature = pr.feature AND cnt.bin = g.bin""", ["edge_lo", "edge_hi"])
_KL = union([f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM loans WHERE {c} IS NOT NULL"
             for c in ["loan_int_rate", "loan_percent_income"]])
oracle("kde", f""", lg AS ({_KL}),
p AS (SELECT feature, CAST(count(*) AS DOUBLE) AS n, stddev_samp(value) * pow(CAST(count(*) AS DOUBLE), -0.2) AS bw,
      min(value) AS mn, max(value) AS mx FROM lg GROUP BY 1),
g AS (SELECT feature, n, bw, range AS gi, (mn - 3 * bw) + range * ((mx - mn + 2 * 3 * bw) / 199) AS x FROM p, range(200))
#SELECT
SELECT g.feature, CAST(gi AS BIGINT) AS grid_index, x,
  sum(exp(-0.5 * ((x - value) / bw) * ((x - value) / bw))) / (n * bw * sqrt(2 * pi())) AS density
FROM g JOIN lg ON g.feature = lg.feature GROUP BY g.feature, gi, x, n, bw""", ["x", "density"])
def _psi(x):
    """digamma of a number of at least 1 in SQL."""
    y = f"(CAST({x} AS DOUBLE) + 6)"
    steps = " - ".join(f"1 / (CAST({x} AS DOUBLE) + {j})" for j in range(6))
    return (f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * pow({y}, 2)) + 1 / (120 * pow({y}, 4)) - 1 / (252 * pow({y}, 6)) "
            f"+ 1 / (240 * pow({y}, 8)) - 1 / (132 * pow({y}, 10)) - {steps})")


_MI = union([f"SELECT '{c}' AS feature, loan_status AS class, CAST({c} AS DOUBLE) AS v FROM loans WHERE {c} IS NOT NULL"
             for c in ["loan_int_rate", "loan_percent_income"]])
oracle("mutual_info_neighbours", f""", lg AS ({_MI}),
pt AS (SELECT feature, class, v, count(*) AS w, sum(count(*)) OVER (PARTITION BY feature, class) AS class_n,
       row_number() OVER (PARTITION BY feature, class ORDER BY v) AS i FROM lg WHERE class IS NOT NULL GROUP BY 1, 2, 3),
gaps AS (SELECT a.feature, a.class, a.v, a.class_n, abs(b.v - a.v) AS gap, b.w - CASE WHEN a.i = b.i THEN 1 ELSE 0 END AS w
         FROM pt a JOIN pt b ON a.feature = b.feature AND a.class = b.class AND b.i BETWEEN a.i - 3 AND a.i + 3
         WHERE a.class_n > 1),
reach AS (SELECT *, sum(w) OVER (PARTITION BY feature, class, v ORDER BY gap RANGE UNBOUNDED PRECEDING) AS got FROM gaps),
dist AS (SELECT feature, class, v, min(gap) FILTER (WHERE got >= least(3, class_n - 1)) AS d FROM reach GROUP BY 1, 2, 3),
every AS (SELECT feature, v, sum(w) AS w FROM pt WHERE class_n > 1 GROUP BY 1, 2),
m AS (SELECT d.feature, d.class, d.v, sum(e.w) AS m FROM dist d JOIN every e ON e.feature = d.feature
      AND CASE WHEN d.d > 0 THEN e.v > d.v - d.d AND e.v < d.v + d.d ELSE e.v = d.v END GROUP BY 1, 2, 3)
#SELECT
SELECT feature, greatest(0, {_psi('sum(w)')} + sum(w * {_psi('least(3, class_n - 1)')}) / sum(w)
  - sum(w * {_psi('class_n')}) / sum(w) - sum(w * {_psi('m')}) / sum(w)) AS mi
FROM pt JOIN m USING (feature, class, v) GROUP BY feature""", ["mi"])
oracle("kde_binned", f""", lg AS ({_KL}),
p AS (SELECT feature, CAST(count(*) AS DOUBLE) AS n, stddev_samp(value) * pow(CAST(count(*) AS DOUBLE), -0.2) AS bw,
      min(value) AS mn, max(value) AS mx FROM lg GROUP BY 1),
q AS (SELECT *, mn - 3 * bw AS g0, bw * sqrt(8 * 1e-4) AS cell FROM p),
cells AS (SELECT feature, i, sum(w) AS w FROM (
  SELECT lg.feature, unnest([floor((value - g0) / cell), floor((value - g0) / cell) + 1]) AS i,
    unnest([1 - ((value - g0) / cell - floor((value - g0) / cell)), (value - g0) / cell - floor((value - g0) / cell)]) AS w
  FROM lg JOIN q USING (feature)) GROUP BY 1, 2),
g AS (SELECT feature, n, bw, g0, cell, range AS gi, g0 + range * ((mx - mn + 2 * 3 * bw) / 199) AS x FROM q, range(200))
#SELECT
SELECT g.feature, CAST(gi AS BIGINT) AS grid_index, x,
  sum(w * exp(-0.5 * pow((x - (g0 + i * cell)) / bw, 2))) / (n * bw * sqrt(2 * pi())) AS density
FROM g JOIN cells ON g.feature = cells.feature GROUP BY g.feature, gi, x, n, bw""", ["x", "density"])
oracle("boxplot_by_class", f""", lg AS ({_LONG}),
qt AS (SELECT feature, loan_status AS class, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
       quantile_cont(value, 0.75) AS q3, count(value) AS n FROM lg WHERE value IS NOT NULL GROUP BY 1, 2),
wk AS (SELECT qt.feature, qt.class, min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) THEN value END) AS whisker_lo,
       max(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN value END) AS whisker_hi
       FROM lg JOIN qt ON lg.feature = qt.feature AND lg.loan_status = qt.class WHERE value IS NOT NULL GROUP BY 1, 2)
#SELECT
SELECT qt.feature, CAST(qt.class AS BIGINT) AS class, q1, median, q3, whisker_lo, whisker_hi,
  CAST(sum(CASE WHEN value < whisker_lo OR value > whisker_hi THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers, n
FROM qt JOIN wk ON qt.feature = wk.feature AND qt.class = wk.class
JOIN lg ON lg.feature = qt.feature AND lg.loan_status = qt.class AND lg.value IS NOT NULL
GROUP BY ALL""", ["q1", "median", "q3", "whisker_lo", "whisker_hi"])
_CL = union([f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, loan_status FROM loans WHERE {c} IS NOT NULL"
             for c in CATEGORICAL])
_CT = (f"SELECT feature, value AS category, CAST(sum(CASE WHEN loan_status = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n0, "
       f"CAST(sum(CASE WHEN loan_status = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n1 FROM ({_CL}) GROUP BY 1, 2")
oracle("crosstab_counts", _CT)
oracle("crosstab_row_pct", f"SELECT feature, category, 100.0 * n0 / (n0 + n1) AS pct0, 100.0 * n1 / (n0 + n1) AS pct1 "
       f"FROM ({_CT})", ["pct0", "pct1"])
oracle("mann_whitney_u", f""", lg AS ({_LONG}),
rk AS (SELECT feature, loan_status, rank() OVER (PARTITION BY feature ORDER BY value)
       + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS mr FROM lg WHERE value IS NOT NULL)
#SELECT
SELECT feature, sum(CASE WHEN loan_status = 0 THEN mr ELSE 0 END)
  - sum(CASE WHEN loan_status = 0 THEN 1 ELSE 0 END) * (sum(CASE WHEN loan_status = 0 THEN 1 ELSE 0 END) + 1) / 2.0 AS u
FROM rk GROUP BY 1""", ["u"])
oracle("chi_square", f""", ct AS ({_CT}),
cells AS (SELECT feature, category, n0 AS o, n0 + n1 AS rt FROM ct UNION ALL SELECT feature, category, n1, n0 + n1 FROM ct),
colt AS (SELECT feature, sum(n0) AS c0, sum(n1) AS c1, sum(n0 + n1) AS nt, count(*) AS r FROM ct GROUP BY 1),
e AS (SELECT ct.feature, n0 AS o, (n0 + n1) * c0 / nt AS e, r FROM ct JOIN colt USING (feature)
      UNION ALL SELECT ct.feature, n1, (n0 + n1) * c1 / nt, r FROM ct JOIN colt USING (feature))
#SELECT
SELECT feature, sum(CASE WHEN r - 1 = 1 THEN pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e
                         ELSE pow(o - e, 2) / e END) AS chi2, CAST(max(r) - 1 AS BIGINT) AS dof
FROM e GROUP BY 1""", ["chi2"])
# 5% critical values of chi-square for 1 and 4 degrees of freedom and of |z|.
oracle("significance_flag", f""", ct AS ({_CT}),
colt AS (SELECT feature, sum(n0) AS c0, sum(n1) AS c1, sum(n0 + n1) AS nt, count(*) AS r FROM ct GROUP BY 1),
e AS (SELECT ct.feature, n0 AS o, (n0 + n1) * c0 / nt AS e, r FROM ct JOIN colt USING (feature)
      UNION ALL SELECT ct.feature, n1, (n0 + n1) * c1 / nt, r FROM ct JOIN colt USING (feature)),
chi AS (SELECT feature, sum(CASE WHEN r = 2 THEN pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e
                                 ELSE pow(o - e, 2) / e END) AS chi2, max(r) - 1 AS dof FROM e GROUP BY 1),
lg AS ({_LONG}),
rk AS (SELECT feature, loan_status, count(*) OVER (PARTITION BY feature, value) AS t,
       rank() OVER (PARTITION BY feature ORDER BY value)
       + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS mr FROM lg WHERE value IS NOT NULL),
u AS (SELECT feature, CAST(count(*) AS DOUBLE) AS n, sum(1.0 - loan_status)::DOUBLE AS n0, sum(loan_status)::DOUBLE AS n1,
      sum((1 - loan_status) * mr) AS r0, sum(t::DOUBLE * t - 1) AS ties FROM rk GROUP BY 1),
z AS (SELECT feature, (greatest(r0 - n0 * (n0 + 1) / 2, n0 * n1 - r0 + n0 * (n0 + 1) / 2) - n0 * n1 / 2 - 0.5)
      / sqrt(n0 * n1 / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM u)
#SELECT
SELECT feature, 'mann_whitney' AS test, CAST(z > 1.959963984540054 AS INTEGER) AS significant FROM z
UNION ALL SELECT feature, 'chi_square', CAST(chi2 > CASE dof WHEN 1 THEN 3.841458820694124
  WHEN 4 THEN 9.487729036781154 END AS INTEGER) FROM chi""")
_HC = [f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM loans"
       for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:]]
oracle("high_corr_pairs", f"SELECT * FROM ({union(_HC)}) WHERE abs(r) > 0.5", ["r"])
_V = ["person_age", "cb_person_cred_hist_length", "loan_int_rate"]
oracle("vif", f""", c AS (SELECT corr({_V[0]}, {_V[1]}) AS r12, corr({_V[0]}, {_V[2]}) AS r13,
       corr({_V[1]}, {_V[2]}) AS r23 FROM loans)
#SELECT
SELECT '{_V[0]}' AS feature, 1 / (1 - (r12 * r12 + r13 * r13 - 2 * r12 * r13 * r23) / (1 - r23 * r23)) AS vif FROM c
UNION ALL SELECT '{_V[1]}', 1 / (1 - (r12 * r12 + r23 * r23 - 2 * r12 * r13 * r23) / (1 - r13 * r13)) FROM c
UNION ALL SELECT '{_V[2]}', 1 / (1 - (r13 * r13 + r23 * r23 - 2 * r12 * r13 * r23) / (1 - r12 * r12)) FROM c""",
       ["vif"])
oracle("mutual_info", f""", xy AS (SELECT feature, value AS x, loan_status AS y, CAST(count(*) AS DOUBLE) AS nxy
       FROM ({_CL}) GROUP BY 1, 2, 3),
t AS (SELECT *, sum(nxy) OVER (PARTITION BY feature, x) AS nx, sum(nxy) OVER (PARTITION BY feature, y) AS ny,
      sum(nxy) OVER (PARTITION BY feature) AS n FROM xy)
#SELECT
SELECT feature, sum(nxy / n * ln(nxy * n / (nx * ny))) AS mi FROM t GROUP BY 1""", ["mi"])

# ------------------------------------------------------------------ sampling
_RANK = ("row_number() OVER (PARTITION BY loan_status ORDER BY md5('42-' || CAST(id AS VARCHAR)), id) - 1")
oracle("stratified_split", f"SELECT id, loan_status, CASE WHEN {_RANK} < round(0.2 * count(*) OVER "
       "(PARTITION BY loan_status)) THEN 'test' ELSE 'train' END AS split FROM loans")
oracle("stratified_kfold", f"SELECT id, loan_status, CAST(({_RANK}) % 5 AS INTEGER) AS fold FROM loans")
_NULLS = "SELECT id, CASE WHEN id % 10 > 0 THEN loan_status END AS loan_status FROM loans"
oracle("stratified_split_nulls", f"SELECT id, loan_status, CASE WHEN {_RANK} < round(0.2 * count(*) OVER "
       f"(PARTITION BY loan_status)) THEN 'test' ELSE 'train' END AS split FROM ({_NULLS})")
oracle("shuffle_batches", "SELECT id, 0 AS epoch, CAST(b AS BIGINT) AS batch FROM (SELECT id, "
       "floor((row_number() OVER (ORDER BY md5('42-0-' || CAST(id AS VARCHAR)), id) - 1) / 32) AS b, "
       "floor(count(*) OVER () / 32) AS nb FROM loans) WHERE b < nb")
oracle("class_weights", "SELECT loan_status AS class, count(*) AS count, "
       "max(count(*)) OVER () / count(*) AS weight FROM loans GROUP BY 1", ["weight"])

# ------------------------------------------------------------------ losses / metrics
oracle("soft_vote", "SELECT id, (score_a + score_b + score_c) / 3 AS score_mean FROM scored", ["score_mean"])
_P = "least(greatest(score_a, 1e-8), 1 - 1e-8)"
oracle("weighted_bce", f"SELECT avg(-(loan_status * ln({_P}) * 6.04 + (1 - loan_status) * ln(1 - {_P}))) "
       "AS loss FROM scored", ["loss"])
oracle("focal_loss", f"SELECT avg(CASE WHEN loan_status = 1 THEN 0.25 ELSE 0.75 END * "
       f"pow(1 - CASE WHEN loan_status = 1 THEN {_P} ELSE 1 - {_P} END, 2) * "
       f"(-loan_status * ln({_P}) - (1 - loan_status) * ln(1 - {_P}))) AS loss FROM scored", ["loss"])
oracle("confusion_matrix", f""", p AS ({PRED})
#SELECT
SELECT CAST(a.a AS BIGINT) AS actual, CAST(b.b AS BIGINT) AS predicted,
  CAST((SELECT count(*) FROM p WHERE loan_status = a.a AND prediction = b.b) AS BIGINT) AS count
FROM (VALUES (0), (1)) a(a), (VALUES (0), (1)) b(b)""")
_CNT = (f"SELECT sum(CASE WHEN loan_status = 1 AND prediction = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp, "
        f"sum(CASE WHEN loan_status = 0 AND prediction = 1 THEN 1 ELSE 0 END)::DOUBLE AS fp, "
        f"sum(CASE WHEN loan_status = 1 AND prediction = 0 THEN 1 ELSE 0 END)::DOUBLE AS fn, "
        f"sum(CASE WHEN loan_status = 0 AND prediction = 0 THEN 1 ELSE 0 END)::DOUBLE AS tn FROM ({PRED})")
oracle("binary_scores", f"SELECT (tp + tn) / (tp + fp + fn + tn) AS accuracy, "
       "CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, "
       "CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall, "
       f"CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM ({_CNT})",
       ["accuracy", "precision", "recall", "f1"])
oracle("classification_report", f""", c AS ({_CNT}),
m AS (SELECT tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, 2 * tn / (2 * tn + fn + fp) AS f0, tn + fp AS s0,
             tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, 2 * tp / (2 * tp + fp + fn) AS f1, tp + fn AS s1,
             tp + fp + fn + tn AS n, (tp + tn) / (tp + fp + fn + tn) AS acc FROM c)
#SELECT
SELECT '0' AS class_name, p0 AS precision, r0 AS recall, f0 AS f1, CAST(s0 AS BIGINT) AS support FROM m
UNION ALL SELECT '1', p1, r1, f1, CAST(s1 AS BIGINT) FROM m
UNION ALL SELECT 'accuracy', NULL, NULL, acc, CAST(n AS BIGINT) FROM m
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, CAST(n AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n,
  CAST(n AS BIGINT) FROM m""", ["precision", "recall", "f1"])
_SC = ("SELECT score_a AS s, CAST(sum(CASE WHEN loan_status = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS n0, "
       "CAST(sum(CASE WHEN loan_status = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS n1 FROM scored GROUP BY 1")
_CUM = (f"SELECT s, n0, n1, coalesce(sum(n0) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b0, "
        f"coalesce(sum(n1) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b1, "
        f"sum(n0) OVER () AS t0, sum(n1) OVER () AS t1 FROM ({_SC})")
oracle("roc_auc", f"SELECT sum(n1 * (b0 + n0 / 2.0)) / (max(t0) * max(t1)) AS auc FROM ({_CUM})", ["auc"])
oracle("roc_curve", f"SELECT s AS threshold, (t0 - b0) / t0 AS fpr, (t1 - b1) / t1 AS tpr FROM ({_CUM}) "
       "UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0", ["threshold", "fpr", "tpr"])
oracle("roc_curve_reduced", f"SELECT s AS threshold, (t0 - b0) / t0 AS fpr, (t1 - b1) / t1 AS tpr FROM ("
       f"SELECT *, lag(n0) OVER (ORDER BY s) AS p0, lag(n1) OVER (ORDER BY s) AS p1 FROM ({_CUM})) "
       "WHERE p0 IS NULL OR p0 <> n0 OR p1 <> n1 UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0",
       ["threshold", "fpr", "tpr"])
oracle("pr_curve", f"SELECT s AS threshold, CASE WHEN (t1 - b1) + (t0 - b0) = 0 THEN 0 ELSE (t1 - b1) / ((t1 - b1) + (t0 - b0)) END "
       f"AS precision, (t1 - b1) / t1 AS recall FROM ({_CUM}) UNION ALL SELECT NULL, 1.0, 0.0",
       ["threshold", "precision", "recall"])
_TS = ", ".join(f"({j}, {t!r})" for j, t in enumerate(F1_SWEEP))
oracle("f1_threshold_sweep", f""", t AS (SELECT j, CAST(threshold AS DOUBLE) AS threshold FROM (VALUES {_TS}) v(j, threshold)),
c AS (SELECT j, threshold, sum(CASE WHEN s.loan_status = 1 AND s.score_a > threshold THEN 1 ELSE 0 END)::DOUBLE AS tp,
      sum(CASE WHEN s.loan_status = 0 AND s.score_a > threshold THEN 1 ELSE 0 END)::DOUBLE AS fp,
      sum(CASE WHEN s.loan_status = 1 AND NOT (s.score_a > threshold) THEN 1 ELSE 0 END)::DOUBLE AS fn
      FROM t, scored s GROUP BY 1, 2),
f AS (SELECT j, threshold, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1,
      CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision,
      CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall FROM c)
#SELECT
SELECT threshold, f1, precision, recall,
  CAST(j = (SELECT min(j) FROM f WHERE f1 = (SELECT max(f1) FROM f)) AS INTEGER) AS best FROM f""",
       ["threshold", "f1", "precision", "recall"])
_MC = union([f"SELECT '{m}' AS model, {e} AS score, loan_status FROM scored" for m, e in [
    ("score_a", "score_a"), ("score_b", "score_b"), ("score_c", "score_c"),
    ("mean", "(score_a + score_b + score_c) / 3")]])
oracle("model_comparison", f""", lg AS ({_MC}),
sc AS (SELECT model, score AS s, CAST(sum(CASE WHEN loan_status = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS n0,
       CAST(sum(CASE WHEN loan_status = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS n1 FROM lg GROUP BY 1, 2),
cu AS (SELECT model, n0, n1, coalesce(sum(n0) OVER (PARTITION BY model ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING
       AND 1 PRECEDING), 0) AS b0, sum(n0) OVER (PARTITION BY model) AS t0, sum(n1) OVER (PARTITION BY model) AS t1 FROM sc)
#SELECT
SELECT model, sum(n1 * (b0 + n0 / 2.0)) / (max(t0) * max(t1)) AS auc FROM cu GROUP BY 1""", ["auc"])
oracle("model_curves", f""", lg AS ({_MC}),
sc AS (SELECT model, score AS s, CAST(sum(CASE WHEN loan_status = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS n0,
       CAST(sum(CASE WHEN loan_status = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS n1 FROM lg GROUP BY 1, 2),
cu AS (SELECT model, s, n0, n1, sum(n0) OVER up AS f0, sum(n1) OVER up AS f1, sum(n0) OVER (PARTITION BY model) AS t0,
       sum(n1) OVER (PARTITION BY model) AS t1, lag(n0) OVER (PARTITION BY model ORDER BY s) AS p0,
       lag(n1) OVER (PARTITION BY model ORDER BY s) AS p1 FROM sc
       WINDOW up AS (PARTITION BY model ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
#SELECT
SELECT model, s AS threshold, f0 / t0 AS fpr, f1 / t1 AS tpr FROM cu WHERE p0 IS NULL OR p0 <> n0 OR p1 <> n1
UNION ALL SELECT DISTINCT model, 'inf'::DOUBLE, 0.0, 0.0 FROM cu""", ["threshold", "fpr", "tpr"])
oracle("prediction_shares", f"SELECT prediction AS value, count(*) AS count, count(*) / sum(count(*)) OVER () AS share "
       f"FROM ({PRED}) GROUP BY 1", ["share"])

# ------------------------------------------------------------------ projection / resampling
oracle("pca_variance", f""", c AS (SELECT abs(corr(person_age, cb_person_cred_hist_length)) AS r FROM loans)
#SELECT
SELECT 1 AS component, (1 + r) / 2 AS variance_ratio, (1 + r) / 2 AS cumulative FROM c
UNION ALL SELECT 2, (1 - r) / 2, 1.0 FROM c""", ["variance_ratio", "cumulative"])
oracle("pca_project_pair", """, c AS (SELECT avg(person_age) AS ma, stddev_pop(person_age) AS sa,
  avg(cb_person_cred_hist_length) AS mb, stddev_pop(cb_person_cred_hist_length) AS sb,
  sign(corr(person_age, cb_person_cred_hist_length)) AS r FROM loans),
x AS (SELECT id, (person_age - ma) / sa AS a, (cb_person_cred_hist_length - mb) / sb AS b, r FROM loans, c)
#SELECT
SELECT id, (a + r * b) / sqrt(2) AS PC1, (a - r * b) / sqrt(2) AS PC2 FROM x""", ["PC1", "PC2"])
_MF = "SELECT id, loan_percent_income AS f1, loan_int_rate / 10 AS f2, loan_status FROM loans"
_KNN = f""", mf AS ({_MF}), m AS (SELECT * FROM mf WHERE loan_status = 1),
pr AS (SELECT a.id, b.id AS nn_id, (a.f1 - b.f1) * (a.f1 - b.f1) + (a.f2 - b.f2) * (a.f2 - b.f2) AS d2
       FROM m a JOIN m b ON a.id <> b.id),
knn AS (SELECT id, CAST(nn_rank AS BIGINT) AS nn_rank, nn_id, sqrt(d2) AS dist FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, nn_id) AS nn_rank FROM pr) WHERE nn_rank <= 5)"""
oracle("knn_minority", f"{_KNN}\n#SELECT\nSELECT * FROM knn", ["dist"])
oracle("knn_minority_wide", """, m AS (SELECT id, loan_percent_income AS f1, loan_int_rate / 10 AS f2,
  cb_person_cred_hist_length / 10 AS f3, loan_amnt / 10000 AS f4 FROM loans WHERE loan_status = 1),
pr AS (SELECT a.id, b.id AS nn_id, (a.f1 - b.f1) * (a.f1 - b.f1) + (a.f2 - b.f2) * (a.f2 - b.f2)
       + (a.f3 - b.f3) * (a.f3 - b.f3) + (a.f4 - b.f4) * (a.f4 - b.f4) AS d2 FROM m a JOIN m b ON a.id <> b.id)
#SELECT
SELECT id, CAST(nn_rank AS BIGINT) AS nn_rank, nn_id, sqrt(d2) AS dist FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, nn_id) AS nn_rank FROM pr) WHERE nn_rank <= 5""", ["dist"])
oracle("smote", f"""{_KNN},
rk AS (SELECT *, row_number() OVER (ORDER BY md5('42-' || CAST(id AS VARCHAR)), id) - 1 AS rank0 FROM m),
par AS (SELECT CAST(sum(CASE WHEN loan_status = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_min,
        CAST(floor(0.5 * sum(CASE WHEN loan_status = 0 THEN 1 ELSE 0 END) - sum(CASE WHEN loan_status = 1 THEN 1 ELSE 0 END))
        AS BIGINT) AS new FROM mf),
g AS (SELECT rk.*, n_min, j.j FROM rk, par,
      LATERAL (SELECT unnest(range(0, new // n_min + CASE WHEN rank0 < new % n_min THEN 1 ELSE 0 END)) AS j) j),
h AS (SELECT g.*, md5('42-' || CAST(id AS VARCHAR) || '-' || CAST(j AS VARCHAR)) AS hx FROM g),
s AS (SELECT h.*, (('0x' || substr(hx, 1, 8))::BIGINT % 5) + 1 AS nn_rank,
      ('0x' || substr(hx, 9, 8))::BIGINT / 4294967296.0 AS u FROM h)
#SELECT
SELECT id, f1, f2, loan_status, 0 AS synthetic FROM mf
UNION ALL
SELECT -(1 + s.rank0 + s.j * s.n_min) AS id, s.f1 + s.u * (n.f1 - s.f1), s.f2 + s.u * (n.f2 - s.f2),
  CAST(1 AS BIGINT), 1 FROM s JOIN knn ON knn.id = s.id AND knn.nn_rank = s.nn_rank JOIN m n ON n.id = knn.nn_id""",
       ["f1", "f2"])

# ------------------------------------------------------------------ tiny fixed net
oracle("mlp_score", f""", mf AS ({_MF}),
h AS (SELECT id, f1 * 1.5 + f2 * 0.25 + (-0.2) AS z1, f1 * (-0.5) + f2 * 0.75 + 0.1 AS z2 FROM mf),
a AS (SELECT id, CASE WHEN z1 > 0 THEN z1 ELSE 0.01 * z1 END AS a1, CASE WHEN z2 > 0 THEN z2 ELSE 0.01 * z2 END AS a2 FROM h)
#SELECT
SELECT id, 1 / (1 + exp(-(a1 * 2.0 + a2 * (-1.0) + (-0.3)))) AS score FROM a""", ["score"])
SQL["mlp_save_load"] = SQL["mlp_score"]
