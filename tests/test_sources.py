import math

from credora.session import scratch_path
from credora.sources.tables import read_table, write_processed


def test_csv_na_tokens_and_nan_become_null(spark):
    path = scratch_path(spark, "csv-src")
    spark.createDataFrame([("1", "NaN", "a"), ("2", "3.5", "NA"), ("3", "", "b")],
                          "id string, x string, k string").coalesce(1) \
        .write.option("header", True).csv(path)
    df = read_table(spark, path, schema="id bigint, x double, k string", fmt="csv")
    rows = {r["id"]: r for r in df.collect()}
    assert rows[1]["x"] is None and rows[2]["x"] == 3.5 and rows[3]["x"] is None
    assert rows[2]["k"] is None and rows[1]["k"] == "a"


def test_parquet_round_trip_keeps_rows(spark, loans_small):
    from credora.operators.features import engineer_eda

    out = scratch_path(spark, "processed")
    df = engineer_eda(loans_small)
    write_processed(df, out)
    back = spark.read.parquet(out)
    assert back.count() == loans_small.count() and set(back.columns) == set(df.columns)
    inf_rows = back.where("person_emp_length_sqrt IS NULL").count()
    assert inf_rows == loans_small.where("person_emp_length IS NULL").count()
    assert not math.isnan(back.agg({"loan_amnt_sqrt": "sum"}).first()[0])
