"""The corpus pipeline: language ID, near-duplicate join, decontamination, mixing, token files.

``STAGES`` are run in turn, each over what the one before kept, written as Parquet in
the shared folder and read again, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskweave.llm import common, decontaminate, language_id, mixing, ngram_jaccard, token_codes


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found."""
    return language_id.keep_known(spark, docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_jaccard.keep_one(spark, docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean_only(spark, docs, common.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources weigh the same, globally shuffled."""
    return mixing.mix(spark, docs).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, described by what is read back from them."""
    return token_codes.encode_corpus(spark, docs)


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_files", tokens),
]

#: SQL can't express the trained stage; tests/llm/test_pipeline.py holds the stages against plain Python on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; a stage's table goes when the next one is written."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = common.new_folder(spark, name)
        docs = common.written(spark, stage(spark, docs, sf_dir), name, path)
        if before:
            common.delete(spark, before)
        before = path
    return docs
