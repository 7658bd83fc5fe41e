"""Exact quantiles (linear interpolation) by distributed selection, one path for all sizes.

Spark's exact ``percentile`` merges a value map of the whole group in one task. Here a
sketch gives, for every wanted order statistic, a value range around it; one pass counts
the distinct values inside each range (a value holding a third of the rows is one row) and
the rows below it, which checks the sketch exactly. Ranges of more than ``select_rows``
distinct values are cut by their own quantiles, and the part that holds the rank is kept:
the count of distinct values shrinks with every turn, so the loop ends and a task never
sorts more than ``select_rows`` rows. A range that missed its rank (a sketch off by more
than its margin) is widened up to the whole column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credora.operators.running import bucket_of, in_few_parts

SELECT_ROWS = 1_000_000   # distinct values one window task may sort
ACCURACY = 10_000
MAX_KEYS = 10_000         # the driver holds one row for each key and probability
COLUMNS_AT_ONCE = 25      # columns whose sketches share one aggregate
PARTS = 64                # parts that a large range is cut into


def exact_quantiles(df: DataFrame, value_col: str, probs: list[float],
                    key_cols: list[str] | None = None, select_rows: int = SELECT_ROWS) -> DataFrame:
    """One row per (key..., p): ``q`` = linear-interpolated quantile of the values that are
    neither NULL nor NaN. NULL keys are groups of their own; a group without values has no
    row. More than ``MAX_KEYS`` keys raise."""
    spark, keys = df.sparkSession, list(key_cols or [])
    base = df.where(F.col(value_col).isNotNull() & ~F.isnan(F.col(value_col).cast("double"))) \
        .select(*keys, F.col(value_col).cast("double").alias("_v"))
    kinds = [(k, dict(base.dtypes)[k]) for k in keys]
    out_schema = ", ".join([f"`{k}` {t}" for k, t in kinds] + ["p double", "q double"])

    def sketch(grid: list[float]) -> list[tuple]:
        rows = in_few_parts(base).groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
            F.percentile_approx("_v", grid, ACCURACY).alias("_b")).limit(MAX_KEYS + 1).collect()
        if len(rows) > MAX_KEYS:
            raise ValueError(f"more than {MAX_KEYS} keys in {keys}")
        return [(tuple(r[k] for k in keys), r["_n"], r["_min"], r["_max"], r["_b"]) for r in rows]

    def pick(ranges: list[tuple], wanted: list[tuple]) -> dict:
        return _pick(spark, _counts_long(spark, base, kinds, ranges), wanted, select_rows)

    found = _solve(probs, sketch, pick)
    return spark.createDataFrame([(*key, p, q) for (key, p), q in found.items()], out_schema)


def wide_quantiles(df: DataFrame, cols: list[str], probs: list[float], select_rows: int = SELECT_ROWS,
                   sketches: dict | None = None) -> dict[tuple[str, float], float]:
    """{(column, p): quantile} of several columns of one table, without turning it into one row for each
    value: one aggregate with the sketches of all columns and one pass that counts what lies below and
    inside the ranges. ``sketches``: those of ``wide_sketches`` with ``grid_of(probs)``, if at hand."""
    given = [sketches]

    def sketch(grid: list[float]) -> list[tuple]:
        own = given.pop() if given else None
        own = wide_sketches(df, cols, grid) if own is None else own
        return [((c,), s["n"], s["low"], s["high"], s["bounds"]) for c, s in own.items()]

    def pick(ranges: list[tuple], wanted: list[tuple]) -> dict:
        return _pick(df.sparkSession, _counts_wide(df, ranges), wanted, select_rows)

    return {(key[0], p): q for (key, p), q in _solve(probs, sketch, pick).items()}


def wide_sketches(df: DataFrame, cols: list[str], grid: list[float], **more) -> dict[str, dict]:
    """{column: n, low, high, bounds (approximate quantiles at ``grid``)} of the values that are neither NULL
    nor NaN, and the aggregates ``more`` (name -> function of the column). ``COLUMNS_AT_ONCE`` columns
    share an aggregate, so that plans stay small; each reads its own columns only."""
    out = {}
    for begin in range(0, len(cols), COLUMNS_AT_ONCE):
        some, aggs = cols[begin:begin + COLUMNS_AT_ONCE], []
        for i, c in enumerate(some):
            v = F.col(f"`{c}`").cast("double")
            real = F.when(~F.isnan(v), v)
            aggs += [F.count(real).alias(f"n{i}"), F.min(real).alias(f"low{i}"), F.max(real).alias(f"high{i}"),
                     F.percentile_approx(real, grid, ACCURACY).alias(f"bounds{i}")]
            aggs += [fn(v).alias(f"{name}{i}") for name, fn in more.items()]
        row = in_few_parts(df).agg(*aggs).first()
        for i, c in enumerate(some):
            out[c] = {name: row[f"{name}{i}"] for name in ("n", "low", "high", "bounds", *more)}
    return out


def grid_of(probs: list[float], margin: float = 3.0 / ACCURACY) -> list[float]:
    """The probabilities around the wanted ones, at which a sketch is read."""
    return sorted({min(1.0, max(0.0, p + s)) for p in probs for s in (-margin, margin)} | {0.0, 1.0})


def _solve(probs: list[float], sketch, pick) -> dict[tuple, float]:
    """{(key, p): quantile}: ranges from the sketch, ranks from ``pick``, wider ranges for what it missed."""
    margin = 3.0 / ACCURACY
    found: dict[tuple, float] = {}
    sizes: dict[tuple, int] = {}
    while True:
        grid = grid_of(probs, margin)
        at = {p: i for i, p in enumerate(grid)}
        ranges, wanted = [], []
        for key, n, least, most, bounds in sketch(grid):
            if not n:
                continue
            sizes[key] = n
            for p in probs:
                low = least if p - margin <= 0 else bounds[at[p - margin]]
                high = most if p + margin >= 1 else bounds[at[p + margin]]
                h = (n - 1) * p
                need = [r for r in {math.floor(h), min(math.floor(h) + 1, n - 1)} if (key, r) not in found]
                if need:
                    # the neighbouring rank may lie just outside: a range needs both
                    ranges.append((*key, len(ranges), low, high))
                    wanted += [(len(ranges) - 1, key, r) for r in need]
        if not wanted:
            break
        found.update(pick(ranges, wanted))
        if all((key, r) in found for _, key, r in wanted):
            break
        margin = margin * 8 if margin < 1 else 2.0
    out = {}
    for key, n in sizes.items():
        for p in probs:
            h = (n - 1) * p
            low, frac = math.floor(h), h - math.floor(h)
            a, b = found[key, low], found[key, min(low + 1, n - 1)]
            out[key, float(p)] = a + (b - a) * frac if frac else a
    return out


def _counts_long(spark, base: DataFrame, kinds, ranges) -> DataFrame:
    """(_rid, _v, _c): occurrences of the values inside each range; _v NULL: values below it."""
    keys = [k for k, _ in kinds]
    table = spark.createDataFrame(ranges, ", ".join(
        [f"`_k{i}` {t}" for i, (_, t) in enumerate(kinds)] + ["_rid int", "_lo double", "_hi double"]))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    # at most MAX_KEYS x probabilities rows
    inside = base.join(F.broadcast(table), same & (F.col("_v") <= F.col("_hi")))
    return inside.groupBy("_rid", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v")) \
        .agg(F.count(F.lit(1)).alias("_c"))


def _counts_wide(df: DataFrame, ranges: list[tuple]) -> DataFrame:
    """The same from the columns themselves; ranges: (column, rid, low, high)."""
    cols = list(dict.fromkeys(r[0] for r in ranges))
    own = [(cols.index(c), rid, low, high) for c, rid, low, high in ranges]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = np.zeros(len(own), np.int64)
        for batch in batches:
            rids, values, counts = [], [], []
            for k, (i, rid, low, high) in enumerate(own):
                v = batch.column(i).to_numpy(zero_copy_only=False)
                below[k] += np.count_nonzero(v < low)
                inside, n = np.unique(v[(v >= low) & (v <= high)], return_counts=True)
                rids.append(np.full(len(inside), rid))
                values.append(inside)
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(rids), pa.int32()), pa.array(np.concatenate(values)),
                 pa.array(np.concatenate(counts), pa.int64())], names=["_rid", "_v", "_c"])
        some = np.flatnonzero(below)
        yield pa.RecordBatch.from_arrays(
            [pa.array([own[k][1] for k in some], pa.int32()), pa.nulls(len(some), pa.float64()),
             pa.array(below[some])], names=["_rid", "_v", "_c"])

    wide = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    return wide.mapInArrow(count, "_rid int, _v double, _c long").groupBy("_rid", "_v").agg(F.sum("_c").alias("_c"))


def _pick(spark, counts: DataFrame, wanted, select_rows: int) -> dict:
    """{(key, rank): value} of the wanted ranks that lie in their ranges."""
    values = counts.checkpoint()
    stats = {r["_rid"]: r for r in values.groupBy("_rid").agg(
        F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_c"))), F.lit(0)).alias("below"),
        F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_c"))), F.lit(0)).alias("inside"),
        F.count("_v").alias("distinct")).collect()}
    # one search for each wanted rank that its range really holds
    search = [(i, rid, key, r, stats[rid]["below"]) for i, (rid, key, r) in enumerate(wanted)
              if rid in stats and stats[rid]["below"] <= r < stats[rid]["below"] + stats[rid]["inside"]]
    distinct = {i: stats[rid]["distinct"] for i, rid, *_ in search}
    if not search:
        return {}
    ids = spark.createDataFrame([(i, rid) for i, rid, *_ in search], "_i int, _rid int")
    rows = values.where(F.col("_v").isNotNull()).join(F.broadcast(ids), "_rid").select("_i", "_v", "_c")
    below = {i: b for i, _, _, _, b in search}
    rank = {i: r for i, _, _, r, _ in search}
    while large := [i for i in rank if distinct[i] > select_rows]:
        big = rows.where(F.col("_i").isin(large))
        bounds = big.groupBy("_i").agg(
            F.percentile_approx("_v", [j / PARTS for j in range(1, PARTS)], ACCURACY).alias("_b"))
        cut = big.join(F.broadcast(spark.createDataFrame(bounds.collect(), bounds.schema)), "_i") \
            .withColumn("_part", bucket_of(F.col("_v"), F.col("_b"), PARTS - 1)).drop("_b").checkpoint()
        counts = cut.groupBy("_i", "_part").agg(F.sum("_c").alias("c"), F.count(F.lit(1)).alias("d")) \
            .orderBy("_i", "_part").collect()
        chosen = {}
        for r in counts:
            i = r["_i"]
            if i not in chosen:
                if rank[i] < below[i] + r["c"]:
                    chosen[i], distinct[i] = r["_part"], r["d"]
                else:
                    below[i] += r["c"]
        keep = spark.createDataFrame(list(chosen.items()), "_i int, _part int")
        rows = rows.where(~F.col("_i").isin(large)).unionByName(
            cut.join(F.broadcast(keep), ["_i", "_part"]).drop("_part"))
    upto = Window.partitionBy("_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    goal = spark.createDataFrame([(i, rank[i] - below[i]) for i in rank], "_i int, _r long")
    hit = rows.withColumn("_upto", F.sum("_c").over(upto)).join(F.broadcast(goal), "_i") \
        .where((F.col("_r") < F.col("_upto")) & (F.col("_r") >= F.col("_upto") - F.col("_c")))
    names = {i: (key, r) for i, _, key, r, _ in search}
    return {names[row["_i"]]: row["_v"] for row in hit.select("_i", "_v").collect()}
