import pytest
from pyspark.sql import functions as F

from gneiss.functions import evidence as E
from gneiss.functions import text as T
from gneiss.functions.html import parse_page, parsed_page, structured_addresses
from gneiss.functions.url import canonical_url, identify, same_site, same_site_columns, skipped_host, url_identity, website_root


@pytest.mark.parametrize(
    "url,expected",
    [
        (" HTTP://Shop.Example.:80/a b?q=é#x ", "http://shop.example/a%20b?q=%C3%A9"), ("example.com", "https://example.com/"), ("example.com/a?b=1", "https://example.com/a"),
        ("https://u:p@example.com:8443/x;v=1?y", "https://example.com:8443/x?y"), ("https://example.com/%E8%8C%B6", "https://example.com/%E8%8C%B6"),
        ("https://example.com:tel/", None), ("https://", None), ("", None), ("https://[::1", None), ("example.com:8080/x", "example.com://8080/x"),
    ],
)
def test_canonical(url, expected):
    assert canonical_url(url) == expected


def test_tenants_and_roots():
    assert identify("https://www.nns.ne.jp/~a/x")[4] == "nns.ne.jp/~a" and identify("https://fruits.jp/ent/b/")[5] == "https://fruits.jp/ent/b/"
    assert identify("https://r.goope.jp/%2e%2e/shop/../tenant/x")[4] == "r.goope.jp/tenant" and identify("https://r.goope.jp/")[7] == ""
    assert identify("https://www.example.com/a/b")[5] == "https://www.example.com/" and identify(None) is None
    assert same_site("https://www.a.com/x", "http://shop.a.com") and not same_site("https://a.com", "https://ba.com") and not same_site("https://a.com:tel", "https://a.com")
    assert same_site("https://r.goope.jp/t/1", "https://r.goope.jp/t") and not same_site("https://r.goope.jp/t", "https://r.goope.jp/u") and not same_site("https://r.goope.jp/", "https://r.goope.jp/")


def test_websites():
    assert website_root("shop.example.com/x; other.com") == "https://shop.example.com/"
    assert all(website_root(x) is None for x in (None, " ", "ftp://a.com", "https://localhost", "facebook.com/x", "https://mit.edu", "r.goope.jp", "a b.com"))


def test_identity_columns(spark):
    rows = [("https://www.a.com/x", "http://shop.a.com/"), ("https://r.goope.jp/t", "https://r.goope.jp/u"), (None, "https://a.com"), ("n/a:x", "https://a.com")]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", url_identity(F.col("a")).alias("x"), url_identity(F.col("b")).alias("y"))
    got = [(r[0], r[1]) for r in df.select(same_site_columns(F.col("x"), F.col("y")), F.coalesce(F.col("x.company_key"), F.lit(""))).collect()]
    assert got == [(a is not None and same_site(a, b), (identify(a) or [""] * 5)[4] if a else "") for a, b in rows]
    hosts = spark.createDataFrame([("www.facebook.com",), ("myfacebook.com",), ("a.edu",), (None,)], "h string")
    assert [r[0] for r in hosts.select(skipped_host(F.col("h"))).collect()] == [True, False, True, False]


def test_text_columns(spark):
    rows = [("a&amp;b\u200b \x1f\u3000c\ue000",), ("�" * 4 + "x" * 50,), ("x" * 400 + "�" * 8,), (None,), ("",), ("Mail A@B.co, a@b.co; c@d.example!",)]
    df = spark.createDataFrame(rows, "t string")
    t = F.col("t")
    got = df.select(T.unescaped(t), T.corrupt(t), T.emails(t), T.mentions(t, ["MAIL", " "]), T.needs_scripts(t)).collect()
    assert got[0][0] == "a&b c" and got[3][0] is None
    assert [r[1] for r in got] == [False, True, False, False, False, False]
    assert got[5][2] == ["a@b.co", "c@d.example"] and got[3][2] == []
    assert [r[3] for r in got] == [False] * 5 + [True] and T.keyword_pattern([]) is None
    assert T.keyword_pattern(["tea", "green tea"]).index("green") < T.keyword_pattern(["tea", "green tea"]).rindex("tea")


def test_decoding(spark):
    page = '<meta charset="Shift_JIS">お茶①'.encode("cp932")
    assert T.decode_page(page).endswith("お茶①") and T.decode_page("é".encode(), "text/html; charset=utf-8") == "é" and T.decode_page(b"\xff") == "�" and T.decode_page(None) is None
    df = spark.createDataFrame([(page, None), (None, None)], "b binary, h string")
    assert [r[0] for r in df.select(T.decoded(F.col("b"), F.col("h"))).collect()] == [T.decode_page(page), None]


PAGE = """<html><head><title>Acme Tea | Home</title><style>x</style><script type="application/ld+json">{"@type":"Cafe","address":{"@type":"PostalAddress","streetAddress":"1 Pier","postalCode":"97001"}}</script></head>
<body><p>Fresh&nbsp;tea</p><a href="/about#x">About <img alt="us"></a><a href="mailto:Hi@Acme.example?s=1">m</a><a href="tel:1">t</a><a href="https://x:tel/">bad</a><iframe src="/menu"></iframe>
<form action="/send"><input name="company"><textarea name="body"></textarea></form><noscript>hidden</noscript></body></html>"""


def test_pages(spark):
    name, title, text, visible, mail, links, form, quality = parse_page(PAGE, "https://acme.example/")
    assert (name, title, form, quality) == ("Acme Tea", "Acme Tea | Home", True, "readable")
    assert "Fresh tea" in visible and "hidden" not in text and text.endswith("[structured data address] 1 Pier, 97001") and mail == ["hi@acme.example"]
    assert links == [{"url": "https://acme.example/about", "text": "About us", "kind": None}, {"url": "https://acme.example/menu", "text": "frame document", "kind": "frame"}] or links[-1]["kind"] == "frame"
    assert parse_page(None, None) is None and parse_page("", "")[0] is None and parse_page("<p", None)[2] == "" and structured_addresses('<script type="application/ld+json">{bad</script>') == []
    df = spark.createDataFrame([(PAGE, "https://acme.example/"), (None, None)], "h string, b string")
    got = df.select(parsed_page(F.col("h"), F.col("b")).alias("p")).where("p.has_form").select("p.company_name", "p.emails").collect()
    assert [tuple(r) for r in got] == [("Acme Tea", ["hi@acme.example"])]


def test_snippets(spark):
    pages = spark.createDataFrame([("a", 1, "u1", "tea tea"), ("a", 2, "u2", "tea tea"), ("a", 3, "u3", "our TEA shop"), ("a", 4, "u4", None), ("b", 1, "u", "steak"), ("c", 1, "u", "none")], "o string, n int, url string, text string")
    got = {r.o: r.snippets for r in E.keyword_snippets(pages, "o", "n", ["tea", "green tea"], limit=3, width=3).collect()}
    assert got == {"a": ["u1 …tea te…", "u2 …ea tea…", "u3 …ur TEA sh…"], "b": ["u …steak…"]}


def test_marks(spark):
    df = spark.createDataFrame([("Home | Menu",), ("Tea | $5",), ("Tea | 5.00",), ("Skip to content",), ("fresh matcha from Uji",), ("matcha",)], "q string")
    got = [tuple(r) for r in df.select(E.navigation_like(F.col("q")), E.thin(F.col("q"), ["matcha"], 2)).collect()]
    assert got == [(True, True), (False, True), (False, True), (True, True), (False, False), (False, True)]
