"""Readers: JSON arrays with their order, candidate lists, CSV with a byte-order mark, HTML bodies, robots rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.text import decoded
from gneiss.functions.url import canonical_url


def json_array(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Elements of JSON array files with their order: ``file_ordinal, pos`` and the fields of ``schema``.

    Files keep the order of ``paths``, elements that of the array. Elements that are no objects have null
    fields; a file that is no array raises once its rows are read.
    """
    return json_elements(spark, paths).select("file_ordinal", "pos", F.from_json("element", schema).alias("e")).select("file_ordinal", "pos", "e.*")


def glob_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Files that a pattern of any Hadoop file system names, in the order of their paths."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


def json_elements(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """As ``json_array`` with each element as its JSON text, so that strings and objects may be mixed."""
    parts = [spark.read.text(p, wholetext=True).select(F.lit(i).alias("file_ordinal"), "value") for i, p in enumerate(paths)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    array = F.from_json(F.regexp_replace("value", "^\ufeff", ""), "array<string>")
    checked = F.when(array.isNull() & F.col("value").isNotNull(), F.raise_error(F.lit("not a JSON array"))).otherwise(array)
    return rows.select("file_ordinal", F.posexplode(checked).alias("pos", "element"))


def candidate_list(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates and invalid rows of a mixed list: bare urls become objects; what has no readable url is invalid.

    ``elements`` has ``file_ordinal, pos, element``. A priority that is no whole number counts as 0.
    """
    shape = "struct<url:string,priority:string,company_name_hint:string,discovery_query:string,discovery_source_url:string>"
    bare = ~F.ltrim("element").startswith("{")
    item = F.from_json("element", shape)
    canonical = F.pandas_udf(lambda urls: urls.map(lambda u: canonical_url(u) if u else None), "string").asNondeterministic()
    rows = elements.select("file_ordinal", "pos", F.when(bare, F.col("element")).otherwise(item["url"]).alias("url"), item.alias("i"))
    rows = rows.withColumn("canonical", canonical("url"))
    priority = F.when(F.col("i.priority").rlike(r"^-?\d{1,9}$"), F.col("i.priority").cast("int")).otherwise(0)
    fields = ["file_ordinal", "pos", "url", "canonical", priority.alias("priority"), "i.company_name_hint", "i.discovery_query", "i.discovery_source_url"]
    return rows.where("canonical IS NOT NULL").select(*fields), rows.where("canonical IS NULL").select("file_ordinal", "pos", "url")


def csv_rows(spark: SparkSession, path: str, required: str) -> DataFrame:
    """Rows of a quoted CSV file with or without a byte-order mark; rows without a value in ``required`` are dropped."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    df = df.toDF(*[c.removeprefix("\ufeff") for c in df.columns])
    return df.where(F.col(f"`{required}`").isNotNull() & (F.col(f"`{required}`") != ""))


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, html`` of stored pages, decoded by their own charset."""
    return spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content"), F.lit(None).cast("string")).alias("html"))


def latest_by_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key: later files and positions overwrite earlier ones; rows without key are left out."""
    row = F.struct(*df.columns)
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.struct(*order)).alias("_row")).select("_row.*")


@lru_cache(maxsize=1_000)
def _rules(text: str) -> RobotFileParser:
    rules = RobotFileParser()
    rules.parse(text.splitlines())
    return rules


def robots_allow(robots: Column, status: Column, url: Column, agent: str) -> Column:
    """Whether robots rules let ``agent`` read a url: 401 and 403 on the rules deny, other failures and no rules allow."""

    def run(texts: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([_rules(t or "").can_fetch(agent, u or "/") for t, u in zip(texts, urls)], dtype=bool)

    return F.when(status.isin(401, 403), False).when(robots.isNull() | (status >= 400), True).otherwise(F.pandas_udf(run, "boolean")(robots, url))
