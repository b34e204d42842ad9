"""Registered queries of the text-corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gneiss.llm import plan_canonical, plan_history, plan_leaks, plan_pages, plan_sentences, plan_tokens

MODULES = (plan_tokens, plan_history, plan_canonical, plan_leaks, plan_sentences, plan_pages)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
