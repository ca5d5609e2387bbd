"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. ``run`` writes what a stage returns as Parquet in the shared folder
and gives it, read again, to the next one; it is deleted when that one is written. All stages but the last return the columns of
``docs``.

Defined cases are those of the operators; a document that is null in any column other than ``text`` goes through like any other,
and a document without text or letters is rejected by language ID.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellumflow.llm import op2_mix_sources, op3_pack_tokens, op5_simhash, op7_decontaminate, op9_language_id
from vellumflow.plans.scratch import materialize, release
from vellumflow.sources.tables import read_table

#: Rows of a batch between Spark and Python. Ten thousand whole texts, Spark's own limit, are tens of MB, held several times over by
#: each task on both sides.
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with batches of ``BATCH_ROWS`` rows or fewer in its session; what it returns is run later, so this stays set."""

    @functools.wraps(stage)
    def run_small(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(_ROWS)) <= BATCH_ROWS:
            spark.conf.set(_ROWS, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_small


@small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled documents are in; others are rejected."""
    return op9_language_id.keep_identified(docs, op9_language_id.learn(docs))


@small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id.

    Documents are linked at a Jaccard similarity of 0.8 or more over shingles of five words.
    """
    return op5_simhash.drop_near_duplicates(docs)


@small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return op7_decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return op2_mix_sources.mix_sources(docs)


@small_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return op3_pack_tokens.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed rows of the documents below ``sf_dir``."""
    docs, before, rows = read_table(spark, sf_dir, "documents"), None, spark.conf.get(_ROWS)
    try:
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            if before is not None:  # its rows have been written on
                release(before)
            before = docs
    finally:
        spark.conf.set(_ROWS, rows)
    return docs


#: Language models and tokenizers have no SQL. The tests hold near-duplicates against the components of all pairs, decontamination
#: against all alignments, mixing against a plain queue and packing against its input.
ORACLE_SQL = None
