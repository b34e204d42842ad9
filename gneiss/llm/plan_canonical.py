"""Queries of problem 2: visually identical text in one form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.canonical import compiled_mapping, one_form, quotes_on_pages
from gneiss.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = table(spark, sf_dir, "audit").select(F.col("audit_id").alias("quote_id"), F.col("evidence_url").alias("url"), F.col("evidence_text_original").alias("quote"))
    crawls = table(spark, sf_dir, "crawls").select(F.col("crawl_id").alias("page_id"), "url", "text")
    found = quotes_on_pages(audit, crawls)
    return found.select(F.col("quote_id").alias("audit_id"), F.col("page_id").alias("crawl_id"))


def p2_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quote in its one form."""
    return table(spark, sf_dir, "audit").select("audit_id", one_form(F.col("evidence_text_original"), compiled_mapping(spark)).alias("form"))


QUERIES = {"p2_found": p2_found, "p2_quotes": p2_quotes}
SQL: dict[str, str] = {}
