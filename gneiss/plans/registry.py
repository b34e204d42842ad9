"""All registered queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators.nested import last_field
from gneiss.plans import leads, nested

MODULES = (nested, leads)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nested.p1_found(spark, sf_dir)
    return found.groupBy("parent_table", last_field(F.col("path")).alias("field")).agg(F.count("*").alias("objects"))
