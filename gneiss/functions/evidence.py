"""Markers of quotes and pages, and snippets around keywords."""

from __future__ import annotations

import re
from collections.abc import Iterable
from math import perm

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks of navigation, prices, franchises, closures, and names of the market, case counting in the last.
NAVIGATION = ("Skip to", "Open Menu", "Close Menu", "Toggle menu", "Log in", "Cart")
BAR = " | "
PRICE = r"\$\s?\d|\d+\.\d{2}"
FRANCHISE = r"(?i)\bfranchis(?:e|ing|ee)\b|\bown a (?:franchise|location|store)\b"
CLOSURE = r"(?iu)permanently closed|we have closed|has closed its doors|closed for good|(?:café|cafe|shop|store) has closed|opening soon|now hiring for our opening"
STATES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DC", "DE", "FL", "GA", "HI", "IA", "ID", "IL", "IN", "KS", "KY", "LA", "MA", "MD", "ME", "MI", "MN", "MO", "MS",
    "MT", "NC", "ND", "NE", "NH", "NJ", "NM", "NV", "NY", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VA", "VT", "WA", "WI", "WV", "WY",
)
STATE_NAMES = (
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut", "Delaware", "District of Columbia", "Florida", "Georgia", "Hawaii", "Idaho",
    "Illinois", "Indiana", "Iowa", "Kansas", "Kentucky", "Louisiana", "Maine", "Maryland", "Massachusetts", "Michigan", "Minnesota", "Mississippi", "Missouri", "Montana",
    "Nebraska", "Nevada", "New Hampshire", "New Jersey", "New Mexico", "New York", "North Carolina", "North Dakota", "Ohio", "Oklahoma", "Oregon", "Pennsylvania",
    "Rhode Island", "South Carolina", "South Dakota", "Tennessee", "Texas", "Utah", "Vermont", "Virginia", "Washington", "West Virginia", "Wisconsin", "Wyoming",
)
MARKET = (rf"\b(?:{'|'.join(STATES)})\s+\d{{5}}\b", r"\bUnited States\b", r"\bU\.S\.A?\.?\b", r"\bUSA\b")
#: The three readings of a market: screening is the narrowest, drafting takes a state's code after a comma as well.
_AUDITED = (*MARKET, rf"\b(?:{'|'.join(STATE_NAMES)})\b", r"\bUS\b", r"\b[A-Za-z]{2}\.?,?\s+\d{5}\b")
MARKETS = {"screen": MARKET, "audit": _AUDITED, "draft": (*_AUDITED, rf"(?i:,\s*(?:{'|'.join(STATES)})\b)")}


def market_pattern(keywords: Iterable[str] = (), reading: str = "screen") -> str:
    """Pattern of a market in one of the three readings: its fixed names and the keywords, case counting."""
    return "|".join([*MARKETS[reading], *(re.escape(k) for k in keywords if k)])


def market_column(keywords: Column, reading: str) -> Column:
    """``market_pattern`` over a column of keyword lists."""
    escaped = F.transform(F.filter(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: k != ""), lambda k: F.regexp_replace(k, r"([^\p{L}\p{N}_\s])", r"\\$1"))
    return F.array_join(F.concat(F.array(*[F.lit(p) for p in MARKETS[reading]]), escaped), "|")


def navigation_like(quote: Column) -> Column:
    """A quote from a menu or title: marks of navigation, or bars without a price."""
    marked = F.lit(False)
    for m in NAVIGATION:
        marked = marked | quote.contains(m)
    return F.coalesce(marked | (quote.contains(BAR) & ~quote.rlike(PRICE)), F.lit(False))


def thin(quote: Column, keywords: Iterable[str], least_words: int) -> Column:
    """A quote without one of the keywords or of fewer words than asked."""
    low = F.lower(F.coalesce(quote, F.lit("")))
    named = F.lit(False)
    for k in keywords:
        named = named | low.contains(k.lower())
    words = F.size(F.filter(F.split(low, r"\s+"), lambda w: w != ""))
    return ~named | (words < least_words)


def snippets_of(pages: list[tuple[str, list[str]]], limit: int) -> list[str]:
    """One snippet a page, in page order, up to ``limit``: the first of a page that no page gave before."""
    out: dict[str, str] = {}
    for url, around in pages:
        if len(out) == limit:
            break
        new = next((s for s in around if s not in out), None)
        if new is not None:
            out[new] = f"{url} …{new}…"
    return list(out.values())


def _around(text: str, pattern: re.Pattern[str], limit: int, width: int) -> list[str]:
    """The first ``limit`` different snippets of a text; no more can matter, as fewer than ``limit`` are taken elsewhere."""
    found: dict[str, None] = {}
    for m in pattern.finditer(text):
        found[" ".join(text[max(0, m.start() - width) : m.end() + width].split())] = None
        if len(found) == limit:
            break
    return list(found)


def pages_that_matter(limit: int) -> int:
    """How many of an owner's pages can be needed: ``limit`` that give a snippet, and those whose lists hold only snippets already taken."""
    return limit + sum(k * perm(limit - 1, k) for k in range(1, limit))


def keyword_snippets(pages: DataFrame, owner: str, order: str, keywords: Iterable[str], limit: int = 3, width: int = 90) -> DataFrame:
    """``owner, snippets``: up to ``limit`` snippets of an owner's pages around any of the keywords.

    Each page is cut to its own snippets first. Of pages with one list of snippets only as many matter as the list
    is long, and of an owner's pages only ``pages_that_matter``; both ranks are cut before the shuffle, so an owner
    with many pages costs no task more than another. Null texts have none.
    """
    terms = sorted({k.strip() for k in keywords if k and k.strip()}, key=lambda k: (-len(k), k))
    if not terms:
        raise ValueError("no keywords")
    found = re.compile("|".join(map(re.escape, terms)), re.I)
    native = "(?iu)" + "|".join(re.escape(t) for t in terms)
    cut = F.pandas_udf(lambda texts: texts.map(lambda t: _around(t, found, limit, width)), "array<string>").asNondeterministic()
    hits = pages.where(F.col("text").rlike(native)).select(owner, order, F.coalesce("url", F.lit("")).alias("url"), cut("text").alias("_around")).where(F.size("_around") > 0)
    alike = F.row_number().over(Window.partitionBy(owner, "_around").orderBy(order, "url"))
    hits = hits.withColumn("_alike", alike).where(F.col("_alike") <= limit)
    nth = F.row_number().over(Window.partitionBy(owner).orderBy(order, "url"))
    hits = hits.withColumn("_nth", nth).where(F.col("_nth") <= pages_that_matter(limit) * limit)
    few = hits.groupBy(owner).agg(F.sort_array(F.collect_list(F.struct("_nth", "url", "_around"))).alias("_pages"))

    def run(groups: pd.Series) -> pd.Series:
        return groups.map(lambda g: snippets_of([(p["url"], list(p["_around"])) for p in g], limit))

    return few.select(owner, F.pandas_udf(run, "array<string>")("_pages").alias("snippets"))


def claim_texts(claims: DataFrame, owner: str, order: str) -> DataFrame:
    """One row per owner with the texts and urls of its claims by type, joined in order; urls once each.

    Claims are gathered by owner and type first, so a hot owner is three rows when the types come together.
    """
    text = F.coalesce(F.when(F.col("evidence_text_ja") != "", F.col("evidence_text_ja")), F.col("evidence_text_original"))
    kinds = ("product", "buyer_role", "target_market")
    said = claims.select(owner, F.col("claim_type").isin(*kinds).alias("_known"), "claim_type", order, text.alias("_text"), F.col("evidence_url").alias("_url"))
    said = said.withColumn("claim_type", F.when(F.col("_known"), F.col("claim_type")))
    item = lambda name: F.when(F.col("claim_type").isNotNull() & (F.col(name) != ""), F.struct(order, name))
    by_type = said.groupBy(owner, "claim_type").agg(F.sort_array(F.collect_list(item("_text"))).alias("_texts"), F.sort_array(F.collect_list(item("_url"))).alias("_urls"))
    joined = by_type.select(owner, "claim_type", F.array_join("_texts._text", " / ").alias("_text"), F.array_join(F.array_distinct("_urls._url"), " / ").alias("_url"))
    one = lambda kind, name: F.coalesce(F.max(F.when(F.col("claim_type") == kind, F.col(name))), F.lit(""))
    return joined.groupBy(owner).agg(*[one(k, "_text").alias(f"{k}_text") for k in kinds], *[one(k, "_url").alias(f"{k}_urls") for k in kinds])
