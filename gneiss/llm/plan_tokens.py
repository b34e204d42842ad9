"""Queries of problem 6: the corpus as token ids."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from gneiss.llm.tokenize import encode_corpus
from gneiss.session import spread, table

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def p6_ids(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return encode_corpus(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", f"{tokenizers}/byte_bpe_50k.json")


QUERIES = {"p6_ids": p6_ids}
SQL: dict[str, str] = {}
