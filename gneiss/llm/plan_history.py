"""Queries of problem 4: candidate batches against all that came before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.history import duplicates
from gneiss.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every intake batch admitted to persisted runs; late roots settled at the end."""
    return duplicates(table(spark, sf_dir, "candidates"), table(spark, sf_dir, "shared_hosts"), batch=F.col("intake_batch"))


def p4_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows known on arrival, each at its own intake batch; rows without a batch come first."""
    return duplicates(table(spark, sf_dir, "candidates"), table(spark, sf_dir, "shared_hosts"), batch=F.col("intake_batch"), settled=False)


QUERIES = {"p4_found": p4_found, "p4_arrivals": p4_arrivals}
SQL: dict[str, str] = {}
