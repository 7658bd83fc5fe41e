"""Registered queries of the operators: each applies its operator to the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, chat, jaccard, lines, mixing, packing, phrases, quality, sharding, spelling, spotsigs,
               substrings, toxicity)

N_SHARDS = 40
MIX_WEIGHTS = [5, 2, 1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.near_duplicates(table(spark, sf_dir, "documents"), threshold="0.8", n=5)
    return out.select("doc_id", "copy_id", "class_id", "n_links")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup_substrings(table(spark, sf_dir, "documents"), n=13)
    return out.select("doc_id", "n_words", "n_removed",
                      F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)],
                                  "conv_id long, turn long, role string, text string")
    out = chat.read_chats(chat.format_chats(turns.unionByName(probe)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(
        F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_documents(table(spark, sf_dir, "documents"),
                                   table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op5_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spotsigs.fingerprint_edits(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        spotsigs.digest(F.col("signatures")).alias("fingerprint"),
        spotsigs.digest(F.col("edited_signatures")).alias("edited_fingerprint"),
        "near_edited", "near_next", F.size("signatures").cast("long").alias("n_signatures"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", "kept", "distance")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=1024,
                                 special_as_text=False)
    return out.select("doc_id", "start", "length", packing.digest(F.col("ids")).alias("ids_crc32"),
                      "doc_tokens", "sequence_id", "offset")


def op8_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(table(spark, sf_dir, "documents"), [1.0] * N_SHARDS,
                                 [1.0] * (N_SHARDS + 1))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                      "grown_shard")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(table(spark, sf_dir, "documents"), MIX_WEIGHTS, (3, 2), 2)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spelling.group_variants(table(spark, sf_dir, "documents"), modulus=97, min_chars=5, min_count=3,
                                  ratio=2)
    return out.select("word", "form", "root", "n", "n_near", "form_n")


def op12_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("word_bpe_49k.json")
    out = bpe.decode_documents(bpe.encode_documents(table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), longest=3, min_count=10, cover_percent=50,
                                top=2000)


REGISTRY = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_toxicity": op4_toxicity,
    "op5_spot_signatures": op5_spot_signatures,
    "op6_quality_rules": op6_quality_rules,
    "op7_packing": op7_packing,
    "op8_rendezvous_shards": op8_rendezvous_shards,
    "op9_line_dedup": op9_line_dedup,
    "op10_source_mix": op10_source_mix,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_bpe_transducer": op12_bpe_transducer,
    "op13_phrase_collocations": op13_phrase_collocations,
}
