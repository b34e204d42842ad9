"""Queries of problem 8: documents as sentence units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gneiss.llm.sentences import split_sentences
from gneiss.session import spread, table


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


QUERIES = {"p8_found": p8_found}
SQL: dict[str, str] = {}
