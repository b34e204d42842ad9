"""Text functions: native columns wherever Spark has them."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's idea of white space, for Java's engine.
WHITE_SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]+"
# Characters that are invisible on a page.
INVISIBLE = r"[\x{e000}-\x{f8ff}\x{200b}-\x{200d}\x{2060}\x{feff}]"
# A word boundary as Python has it: Java's own counts a combining mark to the letter before it.
_WORD = r"[\p{L}\p{N}_]"
_BOUNDARY = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
# Fixed value: the shape of an address.
EMAIL = rf"(?i){_BOUNDARY}[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{{2,}}{_BOUNDARY}"
REPLACEMENT = "\ufffd"


def collapsed(text: Column) -> Column:
    """Text without invisible characters, white space runs as one space; entities stay."""
    bare = F.regexp_replace(text, INVISIBLE, "")
    return F.trim(F.regexp_replace(bare, WHITE_SPACE, " "))


def unescaped(text: Column) -> Column:
    """``collapsed`` after resolving HTML entities; the Python pass touches only texts with an ampersand."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)

    return collapsed(F.pandas_udf(run, "string")(text))


def corrupt(text: Column) -> Column:
    """More replacement characters than three and than a fiftieth of the text."""
    bad = F.length(text) - F.length(F.replace(text, F.lit(REPLACEMENT), F.lit("")))
    return F.coalesce(bad > F.greatest(F.lit(3), F.floor(F.length(text) / 50)), F.lit(False))


def emails(text: Column) -> Column:
    """Sorted distinct addresses of a text in lower case; an empty list for null."""
    found = F.regexp_extract_all(text, F.lit(f"({EMAIL})"), F.lit(1))
    return F.coalesce(F.array_sort(F.array_distinct(F.transform(found, F.lower))), F.array().cast("array<string>"))


def keyword_pattern(keywords: Iterable[str]) -> str | None:
    """Alternation of the keywords, longest first, for a search anywhere in a text without regard to case; None for none."""
    terms = sorted({k.strip() for k in keywords if k and k.strip()}, key=lambda k: (-len(k), k))
    return "(?iu)(?:" + "|".join(re.escape(t).replace("\\ ", " ") for t in terms) + ")" if terms else None


def mentions(text: Column, keywords: Iterable[str]) -> Column:
    """Whether a text holds one of the keywords; false for null text and for no keywords."""
    pattern = keyword_pattern(keywords)
    return F.coalesce(text.rlike(pattern), F.lit(False)) if pattern else F.lit(False)


def needs_scripts(visible: Column) -> Column:
    """A page that shows little, asks for scripts or is corrupt."""
    low = F.lower(visible)
    return (F.length(visible) < 200) | low.contains("enable javascript") | low.contains("javascript is required") | corrupt(visible)


def stable_key(name: Column) -> Column:
    return F.sha2(name, 256)


def joined(items: Column, separator: str = " / ") -> Column:
    """Distinct non-empty items in their order, joined."""
    return F.array_join(F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != ""))), separator)


_META_CHARSET = re.compile(rb"""<meta[^>]+charset=["']?\s*([A-Za-z0-9_\-]+)""", re.I)
#: Names by which pages mean a wider encoding than they say.
WIDER = {"shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "iso-8859-1": "cp1252", "latin-1": "cp1252", "gb2312": "gb18030", "euc-kr": "cp949"}


def decode_page(body: bytes | None, header: str | None = None, limit: int = 2_000_000) -> str | None:
    """Text of a page: charset from the header, else from its meta tag, else UTF-8; unknown bytes are replaced."""
    if body is None:
        return None
    body = bytes(body[:limit])
    found = re.search(r"charset=[\"']?([\w\-]+)", header or "", re.I)
    name = found[1] if found else (m[1].decode("ascii") if (m := _META_CHARSET.search(body[:4096])) else "utf-8")
    try:
        return body.decode(WIDER.get(name.lower(), name), "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def decoded(body: Column, header: Column) -> Column:
    """``decode_page`` over binary columns."""

    def run(bodies: pd.Series, headers: pd.Series) -> pd.Series:
        return pd.Series([decode_page(b, h) for b, h in zip(bodies, headers)], dtype=object)

    return F.pandas_udf(run, "string")(body, header)
