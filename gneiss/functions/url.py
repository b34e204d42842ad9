"""URL canonicalisation and company identity.

``identify`` is the one Python pass over a URL; everything after it is native columns.
Java's URL functions disagree with these rules on spaces, underscores and IDN hosts.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from ipaddress import ip_address
from posixpath import normpath
from urllib.parse import quote, unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hosts on which each tenant is a company, as patterns with the forms of a tenant's path.
TILDE_HOSTS = re.compile(r"(?:www\d*\.)?(?:nns\.ne\.jp|fruits\.jp)")
SEGMENT_HOSTS = frozenset(("r.goope.jp", "yamanashi-machitsukuri.jp", "www.yamanashi-machitsukuri.jp"))
# Hosts that don't identify one company's own site.
SKIPPED_HOSTS = (
    "facebook.com", "instagram.com", "twitter.com", "x.com", "tiktok.com", "youtube.com", "linkedin.com", "pinterest.com", "linktr.ee", "linkin.bio", "beacons.ai",
    "bio.site", "yelp.com", "tripadvisor.com", "google.com", "goo.gl", "g.page", "maps.app.goo.gl", "foursquare.com", "opentable.com", "resy.com", "doordash.com",
    "ubereats.com", "grubhub.com", "seamless.com", "postmates.com", "toasttab.com", "order.online", "squareup.com", "square.site", "clover.com", "chownow.com",
    "menufy.com", "slicelife.com", "amazon.com", "etsy.com", "faire.com", "ebay.com", "wixsite.com", "weebly.com", "godaddysites.com", "blogspot.com", "wordpress.com",
    "business.site", "carrd.co", "myshopify.com", "sites.google.com", "wikipedia.org", "openstreetmap.org",
)
SKIPPED_ZONES = (".edu", ".gov", ".mil")
PATH_SAFE = "/%:@-._~!$&'()*+,;="
QUERY_SAFE = "?" + PATH_SAFE
DEFAULT_PORTS = {"http": 80, "https": 443}

IDENTITY = "canonical string, scheme string, host string, domain_key string, company_key string, root_url string, shared boolean, tenant string"


@lru_cache(maxsize=50_000)
def parts(url: str) -> tuple[str, str, str, str, str] | None:
    """Scheme, host, authority, path and query in canonical spelling; None for a URL without host or with an invalid port.

    A missing scheme is https, and the query of an address without scheme is lost. User, parameters,
    fragment, default port and a dot after the host fall away; an empty path is "/".
    """
    try:
        seen = urlparse(url.strip())
        scheme = seen.scheme.lower() or "https"
        if seen.path and not seen.netloc:
            seen = urlparse(f"{scheme}://{seen.path}")
        port = seen.port
        host = (seen.hostname or "").lower().rstrip(".")
    except ValueError:
        return None
    if not host:
        return None
    authority = host if port in (None, DEFAULT_PORTS.get(scheme)) else f"{host}:{port}"
    return scheme, host, authority, quote(seen.path or "/", safe=PATH_SAFE), quote(seen.query, safe=QUERY_SAFE)


def canonical_url(url: str) -> str | None:
    """The canonical spelling of a URL, None where there is none."""
    found = parts(url)
    if found is None:
        return None
    scheme, _, authority, path, query = found
    return f"{scheme}://{authority}{path if path.startswith('/') else '/' + path}" + (f"?{query}" if query else "")


def tenant_path(host: str, path: str) -> str:
    """Path of the tenant on a shared host, "" elsewhere and where no tenant is named."""
    tilde = bool(TILDE_HOSTS.fullmatch(host))
    if not tilde and host not in SEGMENT_HOSTS:
        return ""
    path = reduce(lambda p, _: unquote(p), range(4), path)
    steps = [s for s in normpath("/" + path.replace("\\", "/").lstrip("/")).split("/") if s]
    if not steps:
        return ""
    if not tilde:
        return f"/{steps[0]}"
    if steps[0][0] == "~":
        return f"/{steps[0]}" if len(steps[0]) > 1 else ""
    return f"/ent/{steps[1]}" if steps[0] == "ent" and len(steps) > 1 else ""


def is_shared(host: str) -> bool:
    return host in SEGMENT_HOSTS or bool(TILDE_HOSTS.fullmatch(host))


def identify(url: str | None) -> tuple | None:
    """All identity fields of a URL (columns of ``IDENTITY``), None where it can't be read."""
    found = parts(url) if url else None
    if found is None:
        return None
    scheme, host, authority, path, _ = found
    domain = host.removeprefix("www.")
    tenant = tenant_path(host, path)
    root = canonical_url(f"{scheme}://{authority}{tenant}/")
    return canonical_url(url), scheme, host, domain, domain + tenant, root, is_shared(host), tenant


def same_site(left: str, right: str) -> bool:
    """One site: equal tenants on shared hosts, else equal hosts or one below the other; unreadable URLs never."""
    a, b = identify(left), identify(right)
    if a is None or b is None:
        return False
    if a[6] or b[6]:
        return bool(a[7] and b[7]) and a[4] == b[4]
    return a[3] == b[3] or a[3].endswith("." + b[3]) or b[3].endswith("." + a[3])


def url_identity(url: Column) -> Column:
    """Struct of ``IDENTITY`` for a URL column; null fields for null and unreadable URLs."""
    names = [f.split()[0] for f in IDENTITY.split(", ")]

    def run(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([identify(u) or (None,) * len(names) for u in urls], columns=names)

    return F.pandas_udf(run, IDENTITY).asNondeterministic()(url)


def with_identity(df: DataFrame, url_col: str, name: str = "identity") -> DataFrame:
    return df.withColumn(name, url_identity(F.col(url_col)))


def same_site_columns(left: Column, right: Column) -> Column:
    """``same_site`` over two identity structs, in native columns; null-safe, false for unreadable URLs."""
    a, b = left["domain_key"], right["domain_key"]
    shared = left["shared"] | right["shared"]
    tenants = (left["tenant"] != "") & (right["tenant"] != "") & (left["company_key"] == right["company_key"])
    plain = (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a))
    return F.coalesce(F.when(shared, tenants).otherwise(plain), F.lit(False))


def record_company(canonical: Column, final: Column) -> Column:
    """Company key of a record: by its canonical url, else its final url; null where that can't be read."""
    return url_identity(F.coalesce(F.when(canonical != "", canonical), F.when(final != "", final)))["company_key"]


def host_in(host: Column, suffixes: list[str] | tuple[str, ...]) -> Column:
    """Whether a host is one of ``suffixes`` or below one."""
    pattern = "(^|[.])(" + "|".join(re.escape(s) for s in suffixes) + ")$"
    return F.coalesce(host.rlike(pattern), F.lit(False))


def skipped_host(host: Column) -> Column:
    """Directories, networks and shops that don't identify one company, and campus or state zones."""
    bare = F.regexp_replace(host, r"^www\.", "")
    return host_in(bare, SKIPPED_HOSTS) | F.coalesce(bare.rlike(r"\.(edu|gov|mil)$"), F.lit(False))


def plain_host(url: Column) -> Column:
    """Host of a URL by pattern, without the Python pass: lower case, without user, port, final dot and leading www."""
    host = F.regexp_extract(F.regexp_replace(F.lower(url), r"^[\s\p{Z}]+", ""), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", "")


def website_root(raw: str | None) -> str | None:
    """Company root of a website tag: the first of a ";" list, with https where it has no scheme.

    None for blank values, unreadable or dotless hosts, other schemes, skipped hosts and shared hosts without tenant.
    """
    value = (raw or "").strip().split(";")[0].strip()
    if not value:
        return None
    found = identify(value if "://" in value else f"https://{value}")
    if not found or found[1] not in DEFAULT_PORTS or "." not in found[2] or " " in found[2]:
        return None
    if found[3].endswith(SKIPPED_ZONES) or any(found[3] == s or found[3].endswith("." + s) for s in SKIPPED_HOSTS):
        return None
    return None if found[6] and not found[7] else found[5]


def refused_target(url: str, addresses: tuple[str, ...] = ()) -> str | None:
    """Why a url must not be fetched, None if it may: only web schemes, ports 80 and 443, and global addresses.

    ``addresses`` are what the host resolves to; a host that is itself an address is checked without them.
    """
    found = parts(url)
    if found is None:
        return "unreadable"
    scheme, host, authority, _, _ = found
    if scheme not in DEFAULT_PORTS:
        return "scheme"
    port = authority[len(host) + 1 :]
    if port and int(port) not in DEFAULT_PORTS.values():
        return "port"
    if host == "localhost":
        return "local"
    for address in (host, *addresses):
        try:
            if not ip_address(address).is_global:
                return "not global"
        except ValueError:
            continue
    return None
