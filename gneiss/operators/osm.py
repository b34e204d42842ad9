"""Map elements: query text, validation, and elements into candidates."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.url import url_identity, website_root

# Keys whose values are lists, and named groups of tags.
LIST_KEYS = frozenset(("cuisine",))
PRESETS = {
    "butcher": ["shop=butcher"], "deli": ["shop=deli"], "department-store": ["shop=department_store"],
    "steak-restaurant": ["cuisine=steak_house", "cuisine=argentinian", "cuisine=brazilian", "cuisine=barbecue"],
    "japanese-restaurant": ["cuisine=japanese", "cuisine=teppanyaki"], "cafe": ["amenity=cafe"], "tea-coffee-shop": ["shop=tea", "shop=coffee"],
    "bakery": ["shop=bakery", "shop=pastry"], "supermarket": ["shop=supermarket"],
}
_SAFE = re.compile(r"[A-Za-z0-9_:.\-]+")
KINDS = ("node", "way", "relation")


def parse_tags(tags: Sequence[str]) -> list[tuple[str, str]]:
    """``key=value`` pairs; characters that could end a quoted string of the query are refused."""
    pairs = []
    for tag in tags:
        key, _, value = tag.partition("=")
        if not _SAFE.fullmatch(key) or not _SAFE.fullmatch(value):
            raise ValueError(f"not a safe tag: {tag}")
        pairs.append((key, value))
    return pairs


def overpass_query(tags: Sequence[tuple[str, str]], area: str, timeout: int = 180) -> str:
    """Query text for all elements with the tags and a website in an area; list keys match an item of their list."""
    if not _SAFE.fullmatch(area):
        raise ValueError(f"not a safe area: {area}")
    lines = [f"[out:json][timeout:{timeout}];", f'area["ISO3166-2"="{area}"][admin_level=4]->.a;', "("]
    for key, value in tags:
        item = f'"{key}"="{value}"' if key not in LIST_KEYS else f'"{key}"~"(^|;) *{value.replace(".", "[.]")} *(;|$)"'
        lines += [f'nwr[{item}]["{site}"](area.a);' for site in ("website", "contact:website")]
    return "\n".join([*lines, ");", "out tags;", ""])


def payload_fault(payload: str | None) -> str | None:
    """Why a whole map answer is refused, None if it may be used: unreadable, without elements, incomplete, or with a malformed element."""
    try:
        answer = json.loads(payload) if payload else None
    except (ValueError, RecursionError):
        return "unreadable"
    if not isinstance(answer, dict) or not isinstance(answer.get("elements"), list):
        return "no elements"
    if answer.get("remark"):
        return "incomplete"
    for e in answer["elements"]:
        tags = e.get("tags") if isinstance(e, dict) else None
        if not isinstance(tags, dict) or e.get("type") not in KINDS or type(e.get("id")) is not int or e["id"] <= 0 or not all(isinstance(v, str) for v in tags.values()):
            return "malformed element"
    return None


def payload_elements(payloads: DataFrame) -> DataFrame:
    """``source, ord, type, id, tags`` of map answers (``source, payload``) that are sound as a whole; one bad element refuses all of its answer."""
    fault = F.pandas_udf(lambda texts: texts.map(payload_fault), "string").asNondeterministic()
    shape = "struct<elements:array<struct<type:string,id:bigint,tags:map<string,string>>>>"
    sound_ones = payloads.withColumn("_fault", fault("payload")).where("_fault IS NULL")
    return sound_ones.select("source", F.posexplode(F.from_json("payload", shape)["elements"]).alias("ord", "e")).select("source", "ord", "e.*")


def sound(kind: Column, number: Column, tags: Column) -> Column:
    """Whether an element is a node, way or relation with a positive id and tags."""
    return F.coalesce(kind.isin(*KINDS) & (number > 0) & tags.isNotNull(), F.lit(False))


def matched_tags(tags: Column, wanted: Sequence[tuple[str, str]]) -> Column:
    """The wanted ``key=value`` pairs that an element has, in their order."""
    hits = []
    for key, value in wanted:
        said = F.try_element_at(tags, F.lit(key))
        items = F.transform(F.split(said, ";"), lambda x: F.trim(x)) if key in LIST_KEYS else F.array(said)
        hits.append(F.when(F.array_contains(items, value), F.lit(f"{key}={value}")))
    return F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else F.array().cast("array<string>")


def _roots(raw: pd.Series) -> pd.Series:
    return raw.map(website_root)


def collapse(elements: DataFrame, wanted: Sequence[tuple[str, str]], most_places: int | None = None) -> DataFrame:
    """One candidate per company from elements with ``ord, type, id, tags``: its root url, name, address, places and tags.

    The first element of a company gives name and address; places counts its elements; tags are distinct in the order
    of the wanted pairs. ``most_places`` leaves out companies with more. Elements without a website, with a skipped host or a shared host without tenant give none.
    """
    tag = lambda key: F.try_element_at("tags", F.lit(key))
    site = F.coalesce(F.when(tag("website") != "", tag("website")), tag("contact:website"))
    rows = elements.where(sound(F.col("type"), F.col("id"), F.col("tags"))).withColumn("url", F.pandas_udf(_roots, "string").asNondeterministic()(site)).where(F.col("url").isNotNull())
    rows = rows.withColumn("company", url_identity(F.col("url"))["company_key"])
    address = F.concat_ws(", ", F.filter(F.array(tag("addr:city"), tag("addr:state")), lambda x: x != ""))
    first = F.struct(
        "url", F.concat_ws("/", F.lit("https://www.openstreetmap.org"), "type", F.col("id").cast("string")).alias("source_url"),
        F.coalesce(F.when(tag("name") != "", tag("name")), tag("brand"), F.lit("")).alias("name"), F.coalesce(tag("brand"), F.lit("")).alias("brand"), address.alias("address"),
    )
    hits = [F.max(F.array_contains(F.col("_matched"), f"{k}={v}")).alias(f"_{i}") for i, (k, v) in enumerate(wanted)]
    grouped = rows.withColumn("_matched", matched_tags(F.col("tags"), wanted)).groupBy("company").agg(F.min_by(first, "ord").alias("_first"), F.min("ord").alias("ord"), F.count("*").alias("locations"), *hits)
    tags = F.filter(F.array(*[F.when(F.col(f"_{i}"), F.lit(f"{k}={v}")) for i, (k, v) in enumerate(wanted)]), lambda x: x.isNotNull()) if wanted else F.array().cast("array<string>")
    grouped = grouped if most_places is None else grouped.where(F.col("locations") <= most_places)
    return grouped.select("company", "ord", "_first.*", "locations", tags.alias("matched_tags"))
