"""The corpus pipeline: five stages, each a step from documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. ``n_chars`` follows the text when a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credora.llm import jaccard, lines, mixing, packing, quality
from credora.llm.frames import materialise
from credora.llm.queries import MIX_WEIGHTS, tokenizer_path
from credora.session import ensure_checkpoint_dir


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go."""
    ensure_checkpoint_dir(spark)
    return quality.keep_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; every document stays."""
    ensure_checkpoint_dir(spark)
    return _counted(lines.drop_frequent_lines(docs, min_docs=10, min_chars=1))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    ensure_checkpoint_dir(spark)
    return jaccard.keep_one(docs, threshold="0.8", n=5)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or cut, so that sources meet their targets in words."""
    ensure_checkpoint_dir(spark)
    return _counted(mixing.mix_documents(docs, MIX_WEIGHTS, share=(3, 2), max_epochs=2))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, one row for each piece, with its ids; ``row`` tells the
    copies of a document apart."""
    ensure_checkpoint_dir(spark)
    return packing.pack_documents(docs, tokenizer_path(), capacity=1024, special_as_text=False)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup),
          ("near_duplicates", near_duplicates), ("source_mix", source_mix), ("packing", pack)]

# Robust estimates and greedy packing are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
