"""Repeatable splitting, folds, epoch batches and class weights.

Row order comes from ``md5('<seed>-<id>')``: exact, engine-independent and free of
partitioning. Ranks inside a class come from bucketed running counts keyed by the
first hex digits of the hash (uniform buckets, so a class holding most rows is still
spread over many tasks); only a parts x 16^digits count table is ever ordered
globally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credora.operators.running import prefix_sums

HEX_DIGITS = 3


def hash_order_key(id_col: str, seed) -> F.Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def hash_rank(df: DataFrame, id_col: str = "id", part_cols: list[str] | None = None,
              seed="42", hex_digits: int = HEX_DIGITS) -> DataFrame:
    """Add ``_rank0`` (0-based position in md5 order within the part) and ``_part_n``."""
    key = hash_order_key(id_col, seed)
    keyed = df.withColumn("_h", key) \
        .withColumn("_hb", F.conv(F.substring("_h", 1, hex_digits), 16, 10).cast("int")) \
        .withColumn("_one", F.lit(1).cast("bigint"))
    ranked = prefix_sums(keyed, ["_h", id_col], ["_one"], part_cols or [], bucket_col="_hb")
    return ranked.withColumnRenamed("_one_before", "_rank0").withColumnRenamed("_one_total", "_part_n") \
        .drop("_h", "_hb", "_one")


def stratified_split(df: DataFrame, label: str = "loan_status", test_frac: float = 0.2,
                     seed=42, id_col: str = "id", split_col: str = "split") -> DataFrame:
    """Per class the first round(test_frac * n_class) rows in hash order are 'test'."""
    r = hash_rank(df, id_col, [label], seed)
    m = F.round(F.col("_part_n") * F.lit(float(test_frac)))
    return r.withColumn(split_col, F.when(F.col("_rank0") < m, "test").otherwise("train")) \
        .drop("_rank0", "_part_n")


def stratified_kfold(df: DataFrame, label: str = "loan_status", k: int = 5, seed=42,
                     id_col: str = "id", fold_col: str = "fold") -> DataFrame:
    """fold = (rank - 1) mod k within each class: class counts per fold differ by <= 1."""
    r = hash_rank(df, id_col, [label], seed)
    return r.withColumn(fold_col, (F.col("_rank0") % k).cast("int")).drop("_rank0", "_part_n")


def shuffle_batches(df: DataFrame, epoch: int, batch_size: int = 32, seed=42,
                    id_col: str = "id") -> DataFrame:
    """Epoch permutation in batches of ``batch_size``; the incomplete batch is dropped."""
    r = hash_rank(df, id_col, None, f"{seed}-{epoch}")
    full = F.floor(F.col("_part_n") / batch_size)
    b = F.floor(F.col("_rank0") / batch_size)
    return r.where(b < full).select(*[F.col(c) for c in df.columns],
                                    F.lit(epoch).alias("epoch"), b.cast("bigint").alias("batch"))


def class_weights(df: DataFrame, label: str = "loan_status") -> DataFrame:
    """Balanced weights: largest class count / class count."""
    c = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("count"))
    mx = c.agg(F.max("count")).scalar()
    return c.select("class", "count", (mx / F.col("count")).alias("weight"))


def with_class_weight(df: DataFrame, label: str = "loan_status", weight_col: str = "weight"
                      ) -> DataFrame:
    """Attach the balanced weight per row; rows of a NULL label are a class of their own."""
    w = class_weights(df, label).select(F.col("class").alias("_class"), F.col("weight").alias(weight_col))
    return df.join(w, F.col(label).eqNullSafe(F.col("_class")), "left").drop("_class")
