"""Search result pages into ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.url import host_in, plain_host

PAYLOAD = "struct<web:struct<results:array<string>>>"
RESULT = "struct<url:string,title:string,description:string>"
# Hosts of directories and portals, which are marked and not dropped.
DIRECTORY_HOSTS = (
    "facebook.com", "instagram.com", "tiktok.com", "youtube.com", "linkedin.com", "pinterest.com", "x.com", "twitter.com", "google.com", "yelp.com", "yelp.de",
    "tripadvisor.com", "tripadvisor.de", "opentable.com", "opentable.de", "quandoo.de", "thefork.de", "wanderlog.com", "foursquare.com", "speisekarte.de",
    "speisekarte.menu", "gelbeseiten.de", "dasoertliche.de", "dastelefonbuch.de", "golocal.de", "meinestadt.de", "werkenntdenbesten.de", "kennstdueinen.de", "11880.com",
    "cylex.de", "branchenbuch.meinestadt.de", "falstaff.com", "falstaff.de", "guide.michelin.com", "wolt.com", "lieferando.de", "ubereats.com", "amazon.de",
    "amazon.com", "ebay.de", "ebay.com", "etsy.com", "faire.com", "knuspr.de", "wikipedia.org", "rekki.com",
)


def ranked_results(payloads: DataFrame, count: int, directories: tuple[str, ...] | list[str] = DIRECTORY_HOSTS) -> DataFrame:
    """Rows of ``query, page, payload`` (JSON text, page from 0) as ranked results.

    Ranks go on from page to page and count results that are left out because their url is no web address.
    Null and unreadable payloads give no row, an odd element costs no other its row; missing titles and descriptions are empty.
    """
    parsed = payloads.select("query", "page", F.posexplode(F.from_json("payload", PAYLOAD)["web"]["results"]).alias("pos", "raw"))
    parsed = parsed.select("query", "page", "pos", F.from_json("raw", RESULT).alias("r"))
    rows = parsed.select("query", (F.col("page") * count + F.col("pos") + 1).cast("bigint").alias("rank"), "r.*").where(F.col("url").rlike("^https?://"))
    return rows.select("query", "rank", "url", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "description")], directory_like(F.col("url"), directories).alias("directory_like"))


def query_failures(answers: DataFrame) -> DataFrame:
    """``query, fault`` of the queries that gave no results: refused (401, 403; nothing is asked after it), failed, or unreadable.

    ``answers`` has query, page, status and payload; a query fails by its first bad page, the pages before it count.
    """
    bad = F.when(F.col("status").isin(401, 403), "refused").when(F.col("status").isNull() | ~F.col("status").between(200, 299), "failed").when(F.from_json("payload", PAYLOAD)["web"].isNull(), "unreadable")
    return answers.withColumn("fault", bad).where("fault IS NOT NULL").groupBy("query").agg(F.min_by("fault", "page").alias("fault"))


def directory_like(url: Column, directories: tuple[str, ...] | list[str] = DIRECTORY_HOSTS) -> Column:
    return host_in(plain_host(url), directories)
