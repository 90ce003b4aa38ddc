"""Queries of this package, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from heatloom.llm import decontaminate, jaccard_join, line_dedup, vector_codes
from heatloom.llm.common import read_table
from heatloom.llm.neighbours import nearest
from heatloom.llm.periodic_runs import run_digests
from heatloom.llm.piece_codec import encode_decode
from heatloom.llm.pii import find_private
from heatloom.llm.quality import quality_scores
from heatloom.llm.simhash import near_duplicates
from heatloom.llm.suffix_dedup import suffix_dedup
from heatloom.llm.token_counts import token_counts
from heatloom.llm.token_store import token_store


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read_table(spark, sf_dir, "documents")).drop("kept")


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(read_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(read_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_digests(read_table(spark, sf_dir, "embeddings"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(read_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_suffix_dedup, op2_piece_codec, op3_private_data, op4_line_dedup, op5_token_counts, op6_simhash, op7_neighbours, op8_decontamination, op9_token_store, op10_quality,
        op11_vector_codes, op12_jaccard_join, op13_periodic_runs,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": line_dedup.ORACLE, "op8_decontamination": decontaminate.ORACLE, "op11_vector_codes": vector_codes.ORACLE, "op12_jaccard_join": jaccard_join.ORACLE}
