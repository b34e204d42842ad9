"""Choosing between the plain and the rendered fetch of a page."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.html import ADDRESS_MARK, structured_addresses
from gneiss.functions.text import collapsed, needs_scripts

#: Answers after which no other way of fetching is tried.
FINAL = (401, 403, 429)


def declared_addresses(html: Column) -> Column:
    """Lines of the postal addresses that a page declares, marked as such; an empty list for null."""

    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: [f"{ADDRESS_MARK} {a}" for a in structured_addresses(p)] if p else [])

    return F.pandas_udf(run, "array<string>")(html)


def choose_fetch(plain: DataFrame, rendered: DataFrame) -> DataFrame:
    """``url, final_url, status, text, fetched_with`` of the fetch to use for each url of ``plain``.

    Both tables have url (unique), final_url, status, html, text and visible_text. The plain fetch is used
    if it shows enough, or got an answer in FINAL; else the rendered one, if there is one. Addresses that only
    the plain page declares are added to a rendered page if both answered 200 at the same final url.
    """
    b = rendered.select("url", *[F.col(c).alias(f"_{c}") for c in ("final_url", "status", "text")])
    joined = plain.join(b, "url", "left")
    failed = F.col("status").isNull() | (F.col("status") >= 400)
    again = (failed | needs_scripts(F.coalesce("visible_text", F.lit("")))) & ~F.coalesce(F.col("status").isin(*FINAL), F.lit(False)) & F.col("_final_url").isNotNull()
    same = (F.col("status") == 200) & (F.col("_status") == 200) & (F.col("final_url") == F.col("_final_url"))
    lines = F.when(F.coalesce(again & same, F.lit(False)), F.filter(declared_addresses(F.col("html")), lambda x: ~F.contains(F.coalesce("_text", F.lit("")), x)))
    text = F.when(again, collapsed(F.concat_ws(" ", F.col("_text"), F.coalesce(lines, F.array().cast("array<string>"))))).otherwise(F.col("text"))
    pick = lambda c: F.when(again, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select("url", pick("final_url"), pick("status"), text.alias("text"), F.when(again, "rendered").otherwise("plain").alias("fetched_with"))
