"""Queries of problems 3 and 5: residue rows and main bodies of crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gneiss.llm.pages import main_body, residue_pages
from gneiss.session import spread, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_pages(spread(table(spark, sf_dir, "crawls").select("crawl_id", "text")), "crawl_id", "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_body(spread(table(spark, sf_dir, "crawls").select("crawl_id", "text")), "crawl_id", "text")


QUERIES = {"p3_found": p3_found, "p5_found": p5_found}
SQL: dict[str, str] = {}
