"""Training-corpus pipeline: language, quality, near duplicates, personal data, packing.

Each stage works on all that the one before it kept; the result of a stage is written as
Parquet to the shared folder and read again. All stages but the last return the columns of
``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import hd_language, packing, parity_join, pii, quality_crf
from logweave.session import cut_lineage

#: All stages share the executors, whose memory grows with the largest batch of any of them: texts are read
#: 512 rows at a time and go to the workers in batches of 2 MB, unless the session has settings of its own.
SMALL = {"spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}

#: A text whose best language has a lower cosine is in none of the known languages, unless it is
#: written in their letters.
MIN_LANGUAGE_SCORE = hd_language.NOISE


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or without likeness to any learned language."""
    return hd_language.filter_known(docs, hd_language.train(docs), MIN_LANGUAGE_SCORE, hd_language.alphabets(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rule or are mostly boilerplate lines."""
    return quality_crf.filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near duplicates (a repeated id once)."""
    return parity_join.one_per_group(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind; n_chars follows the new text."""
    masked = pii.mask(docs, pii.train(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    pieces = packing.tokenise(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.place(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, in a session set to small batches."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = spark.conf.getAll
        for name, value in SMALL.items():
            if name not in own:
                spark.conf.set(name, value)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", bounded(language)),
    ("quality", bounded(quality)),
    ("near_duplicates", bounded(near_duplicates)),
    ("personal_data", bounded(personal_data)),
    ("packing", bounded(packed)),
]

#: CRF labels, hyperdimensional profiles and tokenizers have no SQL form; see tests/llm/test_table_operators.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
