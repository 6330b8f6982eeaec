"""The queries of this subpackage, each over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, kd_shards, language_id, line_dedup, media_jpeg, merkle, mixing, oracles, packing, quality_rules, simhash_neardup, spelling, substring_dedup, token_files
from plumbline.llm.common import Scratch, table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The vocabulary file: in PLUMBLINE_TOKENIZERS if set, else where the installed package has it."""
    if folder := os.environ.get("PLUMBLINE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.score(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op2_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_jpeg.read_back(Scratch(spark, "media").write(media_jpeg.store(table(spark, sf_dir, "documents"))))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards.shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.find_passages(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.by_position(mixing.plan(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "position")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_files(token_files.write_files(table(spark, sf_dir, "documents"), vocabulary()))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    pieces = Scratch(spark, "pieces").write(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    step = packing.steps(pieces).select("sequence_id", F.format_string("%d-%d-%d", "step.lane", "step.tier", "step.number").alias("step"))
    return pieces.join(step, "sequence_id").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spelling.group_variants(spelling.count_words(spelling.with_slips(spelling.runs(docs))))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    true, tampered = merkle.leaf(*fields, F.col("text")), merkle.leaf(*fields, merkle.lower_ascii(F.col("text")))
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    out = merkle.prove(docs.select(F.col("doc_id").alias("key"), F.col("source").alias("grp"), true.alias("node"), F.when(chosen, tampered).otherwise(true).alias("claim")))
    return out.withColumnsRenamed({"key": "doc_id", "grp": "source"})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_simhash_neardup, op3_media_jpeg, op4_bpe, op5_language_id, op6_kd_shards, op7_substring_dedup, op8_mixing, op9_line_dedup, op10_token_files, op11_packing, op12_spelling_variants, op13_merkle_manifest)
}
ORACLES: dict[str, str] = {"op12_spelling_variants": oracles.SPELLING, "op13_merkle_manifest": oracles.merkle()}
