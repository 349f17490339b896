"""A training-data pipeline over the table documents: rules, line and document deduplication, decontamination, packing.

Each stage reads whole texts of any length. Null, empty and blank texts fail the rules of the first stage; where a later
stage gets some, near-copy removal and decontamination leave them and line deduplication drops them, as no word is left.
Null ids stay ids: such rows are judged like others and come last where an order decides. Rows with an equal id and text
are copies, of which near-copy removal keeps one; rows with an equal id and different texts are documents of their own.
Ties go to the smaller id, then the smaller line number or hash of the text. An empty table passes through as one. Columns
of any other name, also those that the operators use inside, stay as they are up to the last stage, which gives its own.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.llm import decontaminate, line_dedup, ngram_join, packing, quality_rules
from clusterloom.llm.common import drop_stored, settled


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars as the text is now."""
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else docs


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go; so do documents that lose too much or fail the base rules."""
    return _counted(quality_rules.clean(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each component of near-equal lines stays; documents without a word left go."""
    return _counted(line_dedup.clean(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays."""
    return ngram_join.distinct(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's length in bytes, its bucket and its batch."""
    return packing.pack_texts(docs)


STAGES = [
    ("quality_rules", rules),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmarks),
    ("packing", batches),
]
#: Components and alignments can't be put in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each other stage is written as Parquet in the shared folder and read back. What a stage needed
    on its way goes once its rows are written, and those once the next stage's are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, settled(partial(stage, spark, docs, sf_dir), name)
        if isinstance(getattr(last, "stored_at", None), str):
            drop_stored(last)
    return STAGES[-1][1](spark, docs, sf_dir)
