"""Rendezvous hashing of stable record keys over weighted shards.

Each record scores every shard with ``-weight / ln(u)``, u from md5(key-shard), and goes to the
highest score. A record's shard depends only on its key, the shard list and the weights, so an
added shard takes records only into itself and a removed one gives up only its own.

Slots (places inside a shard, gapless from 0) follow the md5 of the key: shards are cut into hash
prefixes, prefix counts become offsets, and only the rows of one prefix are sorted together.

Defined cases: a null key hashes as the text ``null``; repeated rows share a shard and get a slot
each; a null text has size ``overhead`` and crc32 0; an empty table gives an empty result; other
input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import digits_for, materialise, md5_bucket, narrow

ROWS_PER_BUCKET = 4000


def _score(key: Column, shard: Column, weight: Column) -> Column:
    """Weighted rendezvous score from 60 bits of md5, strictly inside (0, 1)."""
    digits = F.substring(F.md5(F.concat_ws("-", key, shard.cast("string"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16 ** 13)
    return -weight / F.ln(u)


def rendezvous_shard(key: Column, weights: list[float], first: int = 0) -> Column:
    """struct(score, shard) of the best of ``len(weights)`` shards numbered from ``first``; equal
    scores go to the higher number."""
    shards = F.array(*[F.struct(F.lit(float(w)).alias("w"), F.lit(first + i).alias("s"))
                       for i, w in enumerate(weights)])
    return F.array_max(F.transform(shards, lambda x: F.struct(
        _score(key, x["s"], x["w"]).alias("score"), x["s"].alias("shard"))))


def assign_shards(docs: DataFrame, weights: list[float], grown_weights: list[float] | None = None,
                  overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and, with ``grown_weights`` (the same shards and more
    after them), grown_shard for every input row."""
    docs = narrow(docs, doc_id=id_col, text=text_col)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + overhead).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.md5(key).alias("order_key"), rendezvous_shard(key, weights).alias("best"))
    grown = F.lit(None).cast("int")
    if grown_weights is not None:
        more = rendezvous_shard(key, grown_weights[len(weights):], len(weights))
        rows = rows.withColumn("more", more)
        grown = F.when(F.col("more.score") >= F.col("best.score"), F.col("more.shard")) \
            .otherwise(F.col("best.shard"))
    rows = materialise(rows.select("doc_id", "size", "text_crc32", "order_key",
                                   F.col("best.shard").alias("shard"), grown.alias("grown_shard")),
                       "shards")
    return _with_slots(rows, len(weights))


def _with_slots(rows: DataFrame, n_shards: int) -> DataFrame:
    digits = digits_for(rows.count(), ROWS_PER_BUCKET * n_shards)
    rows = rows.withColumn("bucket", md5_bucket(F.col("order_key"), digits))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = (Window.partitionBy("shard").orderBy("bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "bucket",
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_slot"))
    inside = Window.partitionBy("shard", "bucket").orderBy(
        "order_key", F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    return (rows.join(offsets, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("first_slot") + F.row_number().over(inside) - 1).alias("slot"),
                    "grown_shard"))


def write_shards(docs: DataFrame, path: str, weights: list[float], id_col: str = "doc_id") -> None:
    """Write all columns of ``docs`` as Parquet folders ``shard=<n>`` by the same law."""
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    docs.withColumn("shard", rendezvous_shard(key, weights)["shard"]) \
        .write.partitionBy("shard").parquet(path)
