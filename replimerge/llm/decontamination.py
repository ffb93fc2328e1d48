"""Benchmark decontamination (operator 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, table
from .containment import block_classes, containment_sql, find_contained


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``doc_id, item_id, containment, first_shingle`` of test items found in documents.

    Items are partitioned by size and searched with windows of their size (see
    :func:`.containment.find_contained`, which also says how nulls, short texts, ties, repeats and
    empty tables come out). Other columns of either table are not read.
    """
    return find_contained(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), block_classes(), threshold=threshold)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs``, with their columns, of which no row of that doc_id contains a test item. Null doc_ids stay."""
    d = fresh(docs, "__leak")
    bad = materialize(contaminated(docs, benchmark, threshold).select(F.col("doc_id").alias(d)).distinct(), "leaks")
    return docs.join(bad, F.col("doc_id") == F.col(d), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "containment")


SQL = containment_sql("SELECT item_id, text FROM benchmark", "item_id")
