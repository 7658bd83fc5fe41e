"""The labelled ``loans`` table derived from the TPC-H-style driver tables.

One row per order that has a lineitem. Every column is a deterministic function of
orders / customer / nation / lineitem, so the table grows with the source data.
The same definition in portable SQL (``LOANS_SQL``) feeds the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credora.sources.tables import load

LOANS_SQL = """
SELECT o.o_orderkey AS id,
  CAST(20 + (c.c_custkey % 60) AS BIGINT) AS person_age,
  CAST(4000 + (c.c_custkey * 7919) % 146000 AS BIGINT) AS person_income,
  c.c_mktsegment AS person_home_ownership,
  CASE WHEN o.o_orderkey % 29 = 0 THEN NULL
       ELSE CAST((c.c_custkey * 13) % 31 AS DOUBLE) END AS person_emp_length,
  o.o_orderpriority AS loan_intent,
  CASE n.n_regionkey WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C'
                     WHEN 3 THEN 'D' ELSE 'E' END AS loan_grade,
  o.o_totalprice / 15 AS loan_amnt,
  CAST(5 + 2 * n.n_regionkey AS DOUBLE) + l.disc * 100 AS loan_int_rate,
  (o.o_totalprice / 15) / (4000 + (c.c_custkey * 7919) % 146000) AS loan_percent_income,
  CASE WHEN c.c_acctbal < 0 THEN 'Y' ELSE 'N' END AS cb_person_default_on_file,
  CAST(2 + (c.c_custkey % 60) + (c.c_custkey * 17) % 37 AS DOUBLE) / 3 AS cb_person_cred_hist_length,
  CASE WHEN LEAST((o.o_totalprice / 15) / (4000 + (c.c_custkey * 7919) % 146000), 1e0)
            + CAST(15 * n.n_regionkey + (o.o_orderkey * 31) % 101 AS DOUBLE) / 100 > 1.63e0
       THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS loan_status
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN (SELECT l_orderkey, MAX(l_discount) AS disc FROM lineitem GROUP BY l_orderkey) l
  ON l.l_orderkey = o.o_orderkey
"""

# Deterministic model-free scores (in (0, 1)) used to exercise the metric operators.
SCORES_SQL = """
SELECT *, loan_percent_income / (1 + loan_percent_income) AS score_a,
       loan_int_rate / 40 AS score_b,
       cb_person_cred_hist_length / 50 AS score_c
FROM loans
"""


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build ``loans``. nation (25 rows, fixed by the schema) is the only broadcast side;
    the lineitem roll-up and orders meet on ``o_orderkey`` so the aggregate's hash
    partitioning is reused by the join."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice",
                                            "o_orderpriority")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal",
                                              "c_mktsegment")
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    li = (load(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount")
          .groupBy("l_orderkey").agg(F.max("l_discount").alias("disc")))
    j = (o.join(li, o.o_orderkey == li.l_orderkey)
         .join(c, o.o_custkey == c.c_custkey)
         .join(F.broadcast(n), c.c_nationkey == n.n_nationkey))
    income = F.lit(4000) + (F.col("c_custkey") * 7919) % 146000
    amnt = F.col("o_totalprice") / 15
    pct = amnt / income
    region = F.col("n_regionkey")
    grade = (F.when(region == 0, "A").when(region == 1, "B").when(region == 2, "C")
             .when(region == 3, "D").otherwise("E"))
    noise = (15 * region + (F.col("o_orderkey") * 31) % 101).cast("double") / 100
    return j.select(
        F.col("o_orderkey").alias("id"),
        (F.lit(20) + F.col("c_custkey") % 60).cast("bigint").alias("person_age"),
        income.cast("bigint").alias("person_income"),
        F.col("c_mktsegment").alias("person_home_ownership"),
        F.when(F.col("o_orderkey") % 29 == 0, F.lit(None).cast("double"))
        .otherwise(((F.col("c_custkey") * 13) % 31).cast("double")).alias("person_emp_length"),
        F.col("o_orderpriority").alias("loan_intent"),
        grade.alias("loan_grade"),
        amnt.alias("loan_amnt"),
        ((F.lit(5) + 2 * region).cast("double") + F.col("disc") * 100).alias("loan_int_rate"),
        pct.alias("loan_percent_income"),
        F.when(F.col("c_acctbal") < 0, "Y").otherwise("N").alias("cb_person_default_on_file"),
        ((F.lit(2) + F.col("c_custkey") % 60 + (F.col("c_custkey") * 17) % 37).cast("double") / 3)
        .alias("cb_person_cred_hist_length"),
        F.when(F.least(pct, F.lit(1.0)) + noise > 1.63, F.lit(1)).otherwise(F.lit(0))
        .cast("bigint").alias("loan_status"),
    )


def scored_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``loans`` plus three deterministic scores for the evaluation operators."""
    df = loans(spark, sf_dir)
    p = F.col("loan_percent_income")
    return df.select("*", (p / (1 + p)).alias("score_a"),
                     (F.col("loan_int_rate") / 40).alias("score_b"),
                     (F.col("cb_person_cred_hist_length") / 50).alias("score_c"))
