"""A training corpus from documents: quality rules, near duplicates, secrets, mixing, packing.

Each stage reads what its predecessor wrote.  Filters keep clean documents; secrets are masked in the text; thinning keeps
the clean domain whole; the last stage returns pieces of packed sequences.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import jaccard_join, mixing, packing, quality_rules, secret_scan
from factloom.llm.common import cleared, delete, shared_dir, stage_tables, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(function: Stage) -> Stage:
    """A stage whose intermediate tables are deleted when the next one begins: its output has been written by then."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with stage_tables(spark):
            return function(spark, docs, sf_dir)

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_documents(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.representatives(docs)


@stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.masked(docs)


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.thinned(docs, table(spark, sf_dir, "labels"))


@stage
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixture", mixture),
    ("packing", sequences),
]

#: Expectation-maximisation, fitted rates and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again; a stage's input goes once its output is written.

    An empty table gives an empty result of the last stage; columns of documents other than doc_id and text pass through the
    filtering stages as they are, whatever their names.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, step in STAGES:
        out = step(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
        out.write.parquet(path)
        cleared(spark)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
