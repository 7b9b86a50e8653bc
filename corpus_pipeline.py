"""A corpus pipeline in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from geohour.llm import decontaminate, packing, quality_rules, simhash, suffixes
from geohour.llm.common import free_name, prepare, read
from geohour.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep. The trees learn from the labelled documents."""
    prepare(spark)
    forest = quality_rules.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    out = free_name(docs, "__rules")
    return quality_rules.judge(docs, forest, out).where(F.col(out)["kept"]).drop(out)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id."""
    return simhash.deduplicate(prepared(spark, docs))


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the bytes of repeated passages."""
    return suffixes.deduplicate(prepared(spark, docs))


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without any window of a benchmark item."""
    prepare(spark)
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; see `packing.pack`."""
    return packing.pack(prepared(spark, docs))


def prepared(spark: SparkSession, docs: DataFrame) -> DataFrame:
    prepare(spark)
    return docs


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_text),
    ("benchmark_decontamination", clean_of_benchmarks),
    ("packing", packed),
]

# Boosted trees and tokens are beyond SQL; the tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; what a stage returns is stored before the next reads it."""
    docs = read(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
