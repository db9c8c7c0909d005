"""The queries of the training-data operators, one for each, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm import audio_media, bpe, chat_format, language_id, lexical_search, line_quality, near_duplicates, secret_scan, sequence_packing, shard_packing, sharded_lloyd, source_mix, url_templates
from trialspark.llm.common import table


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.held_out_predictions(table(spark, sf_dir, "documents"))


def op7_audio_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_media.media_digests(table(spark, sf_dir, "documents"))


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.verdicts(table(spark, sf_dir, "documents"))


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of a page is that of the document with its number: bad if of low quality or toxic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_templates.judged(pages, labels, url_templates.RULES).drop("url")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat_digests(table(spark, sf_dir, "conversations"))


def op3_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digests(table(spark, sf_dir, "documents"))


def op4_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_packing.packed(table(spark, sf_dir, "documents"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents"))


def op10_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_best_fit_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_sharded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded_lloyd.clustered(table(spark, sf_dir, "embeddings"))


def op13_best_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.searched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_url_templates": op1_url_templates,
    "op2_chat_format": op2_chat_format,
    "op3_secret_automaton": op3_secret_automaton,
    "op4_best_fit_shards": op4_best_fit_shards,
    "op5_order_minhash": op5_order_minhash,
    "op6_kneser_ney": op6_kneser_ney,
    "op7_audio_media": op7_audio_media,
    "op8_line_quality": op8_line_quality,
    "op9_source_mix": op9_source_mix,
    "op10_forced_bpe": op10_forced_bpe,
    "op11_best_fit_sequences": op11_best_fit_sequences,
    "op12_sharded_lloyd": op12_sharded_lloyd,
    "op13_best_positions": op13_best_positions,
}
ORACLES = {
    "op1_url_templates": url_templates.SQL,
    "op2_chat_format": chat_format.SQL,
    "op3_secret_automaton": secret_scan.SQL,
    "op8_line_quality": line_quality.SQL.format(docs="documents"),
    "op9_source_mix": source_mix.SQL,
    "op12_sharded_lloyd": sharded_lloyd.SQL,
    "op13_best_positions": lexical_search.SQL,
}
