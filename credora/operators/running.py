"""Running sums in global order without a single-partition window.

A window ``ORDER BY x`` with no ``PARTITION BY`` moves every row into one task. Here the
order key is cut into buckets (approximate quantile boundaries, or a given bucket
column such as a hash prefix), bucket totals become exclusive offsets on a table of
at most parts x buckets rows, and the running sum inside a bucket is an ordinary
partitioned window. Results are exact: the boundaries only decide how the work is
split, never which rows are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_BUCKETS = 64
MAX_PARTS = 10_000
MIN_PARTS = 16
ABSENT = "\u0000"


def n_order_buckets(spark) -> int:
    """As many buckets as the session's shuffles have tasks, so that parallelism follows the
    cluster and not a constant."""
    return max(MIN_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions", "64")))


def in_few_parts(df: DataFrame) -> DataFrame:
    """``df`` in no more parts than the least multiple of the cores that reaches ``MIN_PARTS``: a sketch of the whole table merges
    those of all parts in one task, whose work then does not grow with the input."""
    cores = max(1, df.sparkSession.sparkContext.defaultParallelism)
    return df.coalesce(cores * -(-MIN_PARTS // cores))


def with_part_keys(df: DataFrame, part_cols: list[str]) -> tuple[DataFrame, list[str]]:
    """Text copies of the part columns in which NULL is a value of its own, so that grouping,
    windows and joins all keep the rows of a NULL part."""
    keys = [f"_p{i}" for i in range(len(part_cols))]
    for k, c in zip(keys, part_cols):
        df = df.withColumn(k, F.coalesce(F.col(c).cast("string"), F.lit(ABSENT)))
    return df, keys


def bucket_of(value: Column, bounds: Column, n_bounds: int) -> Column:
    """Number of entries of the sorted array ``bounds`` (fixed length) that are <= value.

    A balanced CASE tree (log2 depth) so it stays inside whole-stage codegen.
    """
    def rec(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(value >= F.element_at(bounds, mid), rec(mid, hi)).otherwise(rec(lo, mid - 1))
    return rec(0, n_bounds)


def with_order_buckets(df: DataFrame, order_col: str, part_cols: list[str],
                       n_buckets: int | None = None, accuracy: int = 10000,
                       bucket_col: str = "_bkt") -> DataFrame:
    """Attach a bucket id that is monotone in ``order_col`` within each part. More than
    ``MAX_PARTS`` parts raise: their boundaries are held by the driver and broadcast."""
    spark = df.sparkSession
    n_buckets = n_buckets or n_order_buckets(spark)
    if n_buckets <= 1:
        return df.withColumn(bucket_col, F.lit(0))
    probs = [i / n_buckets for i in range(1, n_buckets)]
    keyed, parts = with_part_keys(df, part_cols)
    bounds = in_few_parts(keyed).groupBy(*parts).agg(
        F.percentile_approx(F.col(order_col), probs, max(accuracy, 20 * n_buckets)).alias("_bounds"))
    rows = bounds.limit(MAX_PARTS + 1).collect()
    if len(rows) > MAX_PARTS:
        raise ValueError(f"more than {MAX_PARTS} parts in {part_cols}")
    if not parts:
        found = rows[0]["_bounds"] if rows else None
        if not found:
            return df.withColumn(bucket_col, F.lit(0))
        joined = df.withColumn("_bounds", F.array(*[F.lit(b) for b in found]))
    else:
        # bounded: at most MAX_PARTS rows of n_buckets - 1 boundaries
        joined = keyed.join(F.broadcast(spark.createDataFrame(rows, bounds.schema)), parts)
    return (joined.withColumn(bucket_col, bucket_of(F.col(order_col), F.col("_bounds"), n_buckets - 1))
            .drop("_bounds", *parts))


def prefix_sums(df: DataFrame, order_cols: list[str], sum_cols: list[str],
                part_cols: list[str] | None = None, bucket_col: str | None = None,
                n_buckets: int | None = None) -> DataFrame:
    """Add ``<c>_before`` (sum of c over rows earlier in ``order_cols`` within the part)
    and ``<c>_total`` (part total) for every c in ``sum_cols``. Rows of a NULL part are a
    part of their own.

    ``order_cols`` must identify a row within its part (aggregate to distinct values
    first). ``bucket_col``: an existing column monotone in the order (e.g. a hash
    prefix); otherwise buckets come from approximate quantiles of ``order_cols[0]``.
    """
    own = [c for c in df.columns]
    if bucket_col is None:
        df = with_order_buckets(df, order_cols[0], list(part_cols or []), n_buckets)
        bucket_col = "_bkt"
    df, parts = with_part_keys(df, list(part_cols or []))
    grp = parts + [bucket_col]
    bsum = df.groupBy(*grp).agg(*[F.sum(c).alias(f"_bs_{c}") for c in sum_cols])
    before_w = (Window.partitionBy(*parts).orderBy(bucket_col)
                .rowsBetween(Window.unboundedPreceding, -1)) if parts else \
        Window.orderBy(bucket_col).rowsBetween(Window.unboundedPreceding, -1)
    total_w = Window.partitionBy(*parts) if parts else Window.partitionBy()
    # parts x buckets rows: the only global window, over a table bounded by construction.
    offsets = bsum.select(*grp, *[
        F.coalesce(F.sum(f"_bs_{c}").over(before_w), F.lit(0)).alias(f"_off_{c}")
        for c in sum_cols
    ], *[F.sum(f"_bs_{c}").over(total_w).alias(f"{c}_total") for c in sum_cols])
    row_w = (Window.partitionBy(*grp).orderBy(*order_cols)
             .rowsBetween(Window.unboundedPreceding, -1))
    # no hint: the window below needs the rows dealt by the same keys anyway
    out = df.join(offsets, grp)
    return out.select(
        *[F.col(c) for c in own if c != "_bkt"],
        *[(F.col(f"_off_{c}") + F.coalesce(F.sum(c).over(row_w), F.lit(0))).alias(f"{c}_before")
          for c in sum_cols],
        *[F.col(f"{c}_total") for c in sum_cols],
    )
