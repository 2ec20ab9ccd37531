"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import (
    binary_records, chat, decontaminate, language_id, lm_scoring, media, oracles, packing, simhash, sort_means, spelling,
    suffix_dedup, token_counts, word_bpe,
)
from corpuslens.llm.common import table_dir


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(table_dir(sf_dir, table))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_read(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.prefix_token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.drop("prefix_changes")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_read(spark, sf_dir, "conversations"))


def op6_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = binary_records.encode_to_records(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_read(spark, sf_dir, "documents"))


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"))


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means.digests(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_language_id": op3_language_id,
    "op4_token_counts": op4_token_counts,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_binary_records": op6_binary_records,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_media_columns": op10_media_columns,
    "op11_word_bpe": op11_word_bpe,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_sort_means": op13_sort_means,
}

#: DuckDB SQL where SQL can express the operator; the others are tested against brute force.
SQL: dict[str, str] = {
    "op1_suffix_array_dedup": oracles.SUFFIX_DEDUP,
    "op5_chat_formatting": chat.SQL,
    "op8_benchmark_decontamination": oracles.DECONTAMINATION,
    "op13_sort_means": oracles.SORT_MEANS,
}
