"""Campaigns as data: their keywords, the order of their links, and faults of their form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators.links import HOSPITALITY_ORDER, ORDER

# Words of buyers by which menus come before products.
HOSPITALITY = ("cafe", "café", "coffee shop", "restaurant", "カフェ", "レストラン")
MODES = {"standard": (50, 100), "batch": (1000, 5000)}


def keywords(df: DataFrame) -> DataFrame:
    """``campaign_id, keyword``: the product's own words, and a ``can_use`` campaign's words of screening where the table has them.

    Blank and null ones are left out, repeated ones stand once.
    """
    none = F.array().cast("array<string>")
    more = F.col("product_evidence.prescreen_keywords") if "prescreen_keywords" in df.schema["product_evidence"].dataType.names else none
    every = F.concat(F.coalesce("product.keywords", none), F.coalesce(F.when(F.col("product_evidence.rule") == "can_use", more), none))
    words = F.array_distinct(F.filter(F.transform(every, lambda k: F.trim(k)), lambda k: k != ""))
    return df.select("campaign_id", F.explode(words).alias("keyword"))


def buyer_words(df: DataFrame) -> Column:
    """Names and keywords of the buyers as one text in lower case."""
    parts = F.flatten(F.transform("buyer_types", lambda b: F.concat(F.array(b["name"]), F.coalesce(b["keywords"], F.array().cast("array<string>")))))
    return F.lower(F.array_join(F.coalesce(parts, F.array().cast("array<string>")), " "))


def link_order(df: DataFrame) -> DataFrame:
    """``campaign_id, groups``: hospitality campaigns read menus, the others products."""
    words = buyer_words(df)
    served = F.coalesce(F.lower("objective").contains("hospitality"), F.lit(False))
    for w in HOSPITALITY:
        served = served | words.contains(w)
    order = lambda groups: F.array(*[F.lit(g) for g in groups])
    return df.select("campaign_id", F.when(served, order(HOSPITALITY_ORDER)).otherwise(order(ORDER)).alias("groups"))


def faults(df: DataFrame) -> DataFrame:
    """``campaign_id, fault``: what a campaign lacks, and numbers out of the range of its mode. Sound campaigns give no row."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    empty = lambda c: F.coalesce(F.size(c) < 1, F.lit(True))
    mode = F.coalesce("research_mode", F.lit("standard"))
    target, most = F.coalesce("target_accepted", F.lit(50)), F.coalesce("max_candidates", F.lit(100))
    highest = lambda i: F.when(mode == "batch", MODES["batch"][i]).otherwise(MODES["standard"][i])
    checks = {
        "id": blank("campaign_id"), "product.name": blank("product.name"), "product.keywords": empty("product.keywords"), "market.name": blank("market.name"),
        "market.keywords": empty("market.keywords"), "buyer_types": empty("buyer_types"), "product_evidence.rule": ~F.coalesce(F.col("product_evidence.rule").isin("already_handles", "can_use"), F.lit(False)),
        "product_evidence.summary_ja": blank("product_evidence.summary_ja"), "research_mode": ~mode.isin(*MODES), "target_accepted": ~target.between(1, highest(0)),
        "max_candidates": ~most.between(1, highest(1)) | (most < target), "max_pages_per_company": ~F.coalesce("max_pages_per_company", F.lit(5)).between(1, 5),
        "batch_size": (mode == "batch") & ~F.coalesce("batch_size", F.lit(50)).between(1, 100),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull())
    return df.select("campaign_id", F.explode(found).alias("fault"))
