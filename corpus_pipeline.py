"""The corpus pipeline over documents: each stage calls an operator of heatloom.llm and works on all that the one before kept.

Every stage takes (spark, docs, sf_dir); its result is written and read again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatloom.llm.common import drop, read_table, stored
from heatloom.llm.decontaminate import uncontaminated
from heatloom.llm.line_dedup import line_dedup
from heatloom.llm.piece_codec import encode_decode
from heatloom.llm.quality import accepted
from heatloom.llm.simhash import first_of_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts have the score of a text without known words; repeated rows and null ids are scored like others."""
    return accepted(docs, read_table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go from the texts; n_chars follows, if there is one. Documents stay, also those left without text; null texts stay null."""
    shorter = line_dedup(docs)
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        shorter = shorter.withColumn("n_chars", n_chars)
    return shorter.select(*[f"`{c}`" for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest id, nulls first. Null and empty texts are copies of one another, and so are repeated rows."""
    return first_of_near_copies(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go. Null and empty texts have none and stay, and so does every row if the benchmark is empty."""
    return uncontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and the text they decode to, as digests. A null text is encoded as the empty one."""
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_copies", near_copies), ("decontamination", benchmark_free), ("piece_codec", pieces)]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; each stage's table goes when the next one's is written. An empty table gives an empty one."""
    docs, before = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
