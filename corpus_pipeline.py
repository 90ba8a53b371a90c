"""A training corpus from raw documents: five operators, each stage's rows written and read again as the next one's.

Each stage works on all rows that its predecessor left. What holds for all of them: null, empty and very long texts, null
and repeated ids, repeated rows, ties and no rows have the results that the operator's module states, and all but the last
return the columns of their input, whatever these are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import mixing, packing, repetition, simhash, weak_quality
from spanloom.llm.common import discard, written
from spanloom.llm.queries import WEIGHTS


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier accepts. Null and wordless texts go; repeated rows stay or go together; no rows: no rows."""
    return weak_quality.keep_good(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't repeat themselves. Null texts go, empty ones stay; a text of any length is judged whole; no rows: no rows."""
    return repetition.keep_unrepetitive(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id (null last; of equal ids one row). Null and wordless texts all stay; no rows: no rows."""
    return simhash.without_near_duplicates(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' target weights ask for. Null is a source of its own; rows of equal id are drawn alike; no rows: no rows."""
    return mixing.mixed(docs, WEIGHTS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences. Texts without tokens give none, long ones as many as they need, repeated rows their own; no rows: no rows."""
    return packing.packed(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Expectation-maximisation, components and packing are iterative: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's input is deleted once its output is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
