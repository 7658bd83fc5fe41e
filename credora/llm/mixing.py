"""Mixing sources to target weights by capped water-filling.

Sources share ``share`` times all words by weight. A source whose share exceeds ``max_epochs``
times its own size is clamped there, and the excess is shared again among the others by weight,
until no share is above its cap. Each source then takes every document ``whole`` times, and the
rest of its target as one more pass over its documents in a seeded order; the last document of that
pass is taken in part, so every source's words meet its target to the word.

The fixpoint of the redistribution is computed from the sources sorted by cap per weight: a source
is clamped exactly if its cap per weight is at most the level left by those before it.

The extra pass is found without sorting a source in one task: documents are cut into prefixes of
the seeded md5, prefix totals become offsets on a small table, and only documents of the prefix in
which a target ends are ordered among themselves.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own,
after the others; rows repeated exactly get equal order keys and are taken one by one; an empty
table or one without words gives targets 0; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import WORD, digits_for, materialise, md5_bucket, row_key, word_count

REPEATS = 1000  # repetitions of a row made from one row
ROWS_PER_BUCKET = 4000


def source_targets(sizes: DataFrame, weights: list[int], share: tuple[int, int] = (3, 2),
                   max_epochs: int = 2) -> DataFrame:
    """source, source_size, target from (source, source_size): one row per source, weights
    repeating in the order of the names (code points, null last)."""
    # Windows over one row per source: the table of sources, never the documents.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = sizes.select(
        "source", "source_size",
        F.get(cycle, (F.row_number().over(order) - 1) % len(weights)).cast("long").alias("weight"),
        (max_epochs * F.col("source_size")).alias("cap"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    num, den = share
    # All in integers up to the last division, so that every engine gets the same double.
    left = num * F.sum("source_size").over(every) \
        - den * F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    steps = ranked.select("*", left.alias("left"), weight_left.alias("weight_left"),
                          F.row_number().over(fill).alias("step"))
    steps = steps.withColumn(
        "clamped", den * F.col("cap") * F.col("weight_left") <= F.col("left") * F.col("weight"))
    level = F.first(F.when(~F.col("clamped"), F.struct("left", "weight_left")), ignorenulls=True) \
        .over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # past the first source that stays under its cap, none is clamped
    leveled = steps.select("*", level.alias("level"),
                           F.min(F.when(~F.col("clamped"), F.col("step"))).over(every).alias("stop"))
    return leveled.select(
        "source", "source_size",
        F.when(F.col("stop").isNull() | (F.col("step") < F.col("stop")), F.col("cap").cast("double"))
        .otherwise((F.col("weight") * F.col("level.left")).cast("double")
                   / (den * F.col("level.weight_left"))).alias("target"))


def mix_sources(docs: DataFrame, weights: list[int], share: tuple[int, int] = (3, 2),
                max_epochs: int = 2, seed: str = "mix", id_col: str = "doc_id",
                text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, whole (full repetitions), extra (words of one more,
    partial or full, repetition), taken, row_key (see ``row_key``) for every input row."""
    key = row_key(docs, text_col)
    docs = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in (
        ("doc_id", id_col), ("text", text_col), ("source", source_col))], key.alias("row_key"))
    rows = materialise(docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), "row_key",
        F.md5(F.concat_ws("-", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"),
                                                        F.lit("null")))).alias("order_key")), "mix")
    # one read: rows and words of each source and hash prefix, at most sources x prefixes rows
    digits = digits_for(rows.count(), ROWS_PER_BUCKET)
    rows = rows.withColumn("bucket", md5_bucket(F.col("order_key"), digits))
    totals = materialise(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")),
                         "mix-totals")
    targets = materialise(source_targets(
        totals.groupBy("source").agg(F.sum("words").alias("source_size")),
        weights, share, max_epochs), "mix-targets")
    plan = targets.select(
        F.col("source").alias("t_source"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(0).cast("long").alias("whole"))
    plan = plan.withColumn("budget", F.floor("target").cast("long")
                           - F.col("whole") * F.col("source_size"))
    running = (Window.partitionBy("source").orderBy("bucket")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.withColumn("words_before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    offsets = (offsets.join(plan, F.col("source").eqNullSafe(F.col("t_source")))
               .select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"),
                       "source_size", "target", "whole",
                       (F.col("budget") - F.col("words_before")).alias("room"), "words"))
    placed = rows.join(offsets, F.col("source").eqNullSafe(F.col("o_source"))
                       & (F.col("bucket") == F.col("o_bucket")))
    ends_here = (F.col("room") > 0) & (F.col("room") < F.col("words"))
    inside = (Window.partitionBy("source", "bucket")
              .orderBy("order_key", F.col("doc_id").asc_nulls_first(), "row_key")
              .rowsBetween(Window.unboundedPreceding, -1))
    cut = placed.filter(ends_here).withColumn(
        "room", F.col("room") - F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed.filter(~ends_here).unionByName(cut).select(
        "doc_id", "source", "size", "source_size", "target", "whole",
        _between(F.col("room"), F.col("size")).alias("extra"),
        (F.col("whole") * F.col("size") + _between(F.col("room"), F.col("size"))).alias("taken"),
        "row_key")


def _between(room: Column, size: Column) -> Column:
    return F.greatest(F.lit(0), F.least(room, size)).cast("long")


def mix_documents(docs: DataFrame, weights: list[int], text_col: str = "text", **mix) -> DataFrame:
    """The mixed rows themselves, with the columns of ``docs``: every document ``whole`` times, and
    once more up to its first ``extra`` words."""
    taken = mix_sources(docs, weights, text_col=text_col, **mix).filter("taken > 0")
    # equal rows meet under one key: they are counted, and their repetitions are rows of bounded size again
    taken = taken.groupBy("row_key", "whole", "extra", "size").agg(F.count(F.lit(1)).alias("n"))
    runs = F.array(F.struct(F.col("size").alias("words"), (F.col("whole") * F.col("n")).alias("times")),
                   F.struct(F.col("extra").alias("words"), F.when(F.col("extra") > 0, F.col("n")).otherwise(0)
                            .alias("times")))
    taken = taken.select("row_key", "size", F.explode(runs).alias("run")).filter("run.times > 0")
    part = F.explode(F.sequence(F.lit(0), F.col("run.times") - 1, F.lit(REPEATS)))
    taken = taken.select("row_key", "size", "run", part.alias("from")).select(
        "row_key", "size", F.col("run.words").alias("words"),
        F.least(F.lit(REPEATS), F.col("run.times") - F.col("from")).cast("int").alias("times"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                        row_key(docs, text_col).alias("row_key")).dropDuplicates(["row_key"])
    rows = (keyed.join(taken, "row_key")
            .select("doc", "size", "words", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_time")))
    text = F.col(f"doc.`{text_col}`")
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), 0),
                                 1, F.col("words").cast("int")), "")
    cut = F.when(F.col("words") < F.col("size"), first).otherwise(text)
    return rows.select(*[cut.alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c)
                         for c in docs.columns])
