"""Categorical encoding from sorted distinct values.

Label codes come from a distributed mapping (distinct values, their global rank, a join), so
any number of levels works. One-hot columns make the result as wide as the levels: their
number is bounded by the documented ``max_levels`` parameter, and more levels raise.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credora.session import scratch_path

MAX_LEVELS = 1000


def fit_categories(df: DataFrame, cols: list[str], max_levels: int = MAX_LEVELS
                   ) -> dict[str, list[str]]:
    """Sorted distinct non-null values per column, all columns in one pass. More than
    ``max_levels`` of one column raise: the lists are held by the driver."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]) \
        .unpivot([], cols, "feature", "value").where(F.col("value").isNotNull())
    rows = long.distinct().limit(max_levels * len(cols) + 1).collect()
    levels = {c: [] for c in cols}
    for r in rows:
        levels[r["feature"]].append(r["value"])
    big = [c for c, v in levels.items() if len(v) > max_levels]
    if big or len(rows) > max_levels * len(cols):
        raise ValueError(f"too many levels to encode (>{max_levels}): {big or cols}")
    return {c: sorted(v) for c, v in levels.items()}


def distinct_codes(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, value, code): the position of every distinct non-null value among the sorted
    ones of its column. Values are sorted over all tasks; a place inside its sorted file and
    the sizes of the files before it make the rank."""
    spark = df.sparkSession
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]) \
        .unpivot([], cols, "feature", "value").where(F.col("value").isNotNull()).distinct()
    path = scratch_path(spark, "codes")
    place = F.monotonically_increasing_id()  # task number, then row inside the task
    long.orderBy("feature", "value").select(
        "feature", "value", F.shiftright(place, 33).alias("part"),
        place.bitwiseAND((1 << 33) - 1).alias("row")).write.parquet(path)
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    before, at = [], 0
    for r in sizes:  # one row for each task of the sort
        before.append((r["part"], at))
        at += r["n"]
    ranked = rows.join(F.broadcast(spark.createDataFrame(before, "part long, before long")), "part") \
        .select("feature", "value", (F.col("before") + F.col("row")).alias("rank"))
    first = ranked.groupBy("feature").agg(F.min("rank").alias("first"))
    return ranked.join(F.broadcast(first), "feature") \
        .select("feature", "value", (F.col("rank") - F.col("first")).cast("int").alias("code"))


def label_encode(df: DataFrame, cols: list[str], levels: dict[str, list[str]] | None = None,
                 suffix: str = "_encoded") -> DataFrame:
    """Code = position in the sorted distinct values; NULL stays NULL. With given ``levels``
    the codes come from them and an unseen value raises."""
    if levels is None:
        codes, out = distinct_codes(df, cols), df
        for i, c in enumerate(cols):
            mine = codes.where(F.col("feature") == c).select(
                F.col("value").alias(f"_v{i}"), F.col("code").alias(f"{c}{suffix}"))
            out = out.drop(f"{c}{suffix}").join(
                mine, F.col(c).cast("string") == F.col(f"_v{i}"), "left").drop(f"_v{i}")
        return out
    new = {}
    for c in cols:
        mapping = F.create_map(*chain.from_iterable(
            (F.lit(v), F.lit(i)) for i, v in enumerate(levels[c])))
        code = mapping[F.col(c).cast("string")]
        new[f"{c}{suffix}"] = F.when(
            F.col(c).isNotNull() & code.isNull(),
            F.raise_error(F.concat(F.lit(f"unseen label in {c}: "), F.col(c).cast("string")))
        ).otherwise(code).cast("int")
    keep = [F.col(f"`{c}`") for c in df.columns if c not in new]
    return df.select(*keep, *[v.alias(k) for k, v in new.items()])


def _dummy(c: str, v: str):
    return F.coalesce((F.col(c).cast("string") == F.lit(v)), F.lit(False)).cast("int")


def one_hot_full(df: DataFrame, cols: list[str], prefixes: list[str] | None = None,
                 levels: dict[str, list[str]] | None = None, max_levels: int = MAX_LEVELS
                 ) -> DataFrame:
    """One 0/1 column per level named ``<prefix>_<value>``; the source column is dropped. A
    column of more than ``max_levels`` levels raises."""
    levels = levels if levels is not None else fit_categories(df, cols, max_levels)
    prefixes = prefixes or cols
    dummies = [_dummy(c, v).alias(f"{p}_{v}") for c, p in zip(cols, prefixes) for v in levels[c]]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in cols], *dummies)


def one_hot_drop_first(df: DataFrame, cols: list[str],
                       levels: dict[str, list[str]] | None = None, max_levels: int = MAX_LEVELS
                       ) -> DataFrame:
    """``<col>_<value>`` for every level but the first sorted one; the source column is
    kept. NULL and unseen values give all zeros (test aligned to the train levels). A column
    of more than ``max_levels`` levels raises."""
    levels = levels if levels is not None else fit_categories(df, cols, max_levels)
    dummies = [_dummy(c, v).alias(f"{c}_{v}") for c in cols for v in levels[c][1:]]
    return df.select(*[F.col(f"`{c}`") for c in df.columns], *dummies)
