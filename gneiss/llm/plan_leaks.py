"""Queries of problem 7: evaluation items in the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gneiss.llm.leaks import find_leaks, find_variants
from gneiss.session import spread, table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "eval_items"))


def p7_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that ask the templates of evaluation items with other numbers, names or units."""
    return find_variants(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "eval_items"))


QUERIES = {"p7_found": p7_found, "p7_variants": p7_variants}
SQL: dict[str, str] = {}
