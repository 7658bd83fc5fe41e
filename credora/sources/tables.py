"""Sources and sinks: typed reads (CSV or Parquet), NaN clean-up, table writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tokens the reference's CSV reader treats as missing (pandas defaults).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, e.g. ``load(spark, '/root/testdata/sf0.01', 'orders')``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Floating NaN becomes NULL (the reference treats NaN as missing; Spark orders it last)."""
    floats = {f.name for f in df.schema.fields
              if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    targets = [c for c in (cols or df.columns) if c in floats]
    if not targets:
        return df
    return df.select(*[
        F.when(F.isnan(F.col(c)), F.lit(None)).otherwise(F.col(c)).alias(c)
        if c in targets else F.col(c)
        for c in df.columns
    ])


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str | None = None) -> DataFrame:
    """Read a labelled table. CSV needs a header: every column is read as text, missing-value
    tokens become NULL, and only then are types applied: those of ``schema`` (a value that does
    not fit is NULL), or without one bigint, double or text, whichever first fits all values
    (one extra pass; give a schema to save it)."""
    fmt = fmt or ("csv" if path.rstrip("/").lower().endswith(".csv") else "parquet")
    if fmt == "csv":
        df = spark.read.option("header", True).option("nullValue", "").csv(path)
        df = df.select(*[F.when(~F.col(f"`{c}`").isin(NA_TOKENS), F.col(f"`{c}`")).alias(c)
                         for c in df.columns])
        if schema is None:
            kinds = infer_types(df)
        else:
            given = spark.createDataFrame([], schema).dtypes
            if len(given) != len(df.columns):
                raise ValueError(f"the schema has {len(given)} columns, the file {len(df.columns)}")
            df = df.toDF(*[c for c, _ in given])
            kinds = dict(given)
        df = df.select(*[F.col(f"`{c}`").try_cast(kinds[c]).alias(c) for c in df.columns])
    else:
        reader = spark.read
        if schema is not None:
            reader = reader.schema(schema)
        df = reader.format(fmt).load(path)
    return nan_to_null(df)


def infer_types(df: DataFrame) -> dict[str, str]:
    """bigint, double or string for every text column, in one aggregate."""
    whole = r"^[+-]?[0-9]{1,18}$"
    checks = []
    for i, c in enumerate(df.columns):
        v = F.trim(F.col(f"`{c}`"))
        checks += [F.count(v).alias(f"n{i}"), F.count_if(v.rlike(whole)).alias(f"b{i}"),
                   F.count(v.try_cast("double")).alias(f"d{i}")]
    row = df.agg(*checks).first()
    return {c: "bigint" if row[f"b{i}"] == row[f"n{i}"] > 0 else
            "double" if row[f"d{i}"] == row[f"n{i}"] > 0 else "string" for i, c in enumerate(df.columns)}


def write_processed(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                    partition_by: list[str] | None = None) -> str:
    """Write an engineered table as a directory (one file per task, no driver hop)."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def write_predictions(df: DataFrame, path: str, id_col: str = "id",
                      pred_col: str = "prediction", label_name: str = "loan_status",
                      fmt: str = "csv") -> str:
    """Write the ``(id, label)`` submission table."""
    out = df.select(F.col(id_col).alias(id_col), F.col(pred_col).cast("bigint").alias(label_name))
    return write_processed(out, path, fmt=fmt)
