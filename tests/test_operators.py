import json
import math
import random

import pytest
from pyspark.sql import functions as F

from gneiss.operators import links as L
from gneiss.operators import osm as O
from gneiss.operators import relations as R
from gneiss.operators.search import ranked_results
from gneiss.sources import json_arrays as J
from gneiss.sources.sinks import NewestRows, Parts, Snapshots, report_csv, write_json, write_labelled_report, write_parts, write_report
from gneiss.streaming.incremental import arrivals, keep_newest, remaining, resume


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_first_and_newest(spark):
    df = spark.createDataFrame([("a", 1, 5), ("b", 2, 5), ("a", 3, 9), (None, 4, 1), (None, 5, 1), ("a", 6, 9)], "k string, o int, age int")
    assert rows(R.first_wins(df, "k", ["o"]), "k", "o") == sorted([("a", 1), ("b", 2), (None, 4)], key=repr)
    assert rows(R.newest_wins(df, "k", "o", ["age", "o"]), "first_position", "o") == sorted([(1, 6), (2, 2), (None, 4), (None, 5)], key=repr)
    once = R.accept_once(df, "k", F.col("o") != 1, ["o"])
    assert rows(once.where("once"), "o") == [(2,), (3,), (4,)]
    assert R.first_wins(df.limit(0), "k", ["o"]).count() == R.newest_wins(df.limit(0), "k", "o", ["age"]).count() == 0


@pytest.mark.parametrize("n,parts", [(7, 3), (10, 4), (5, 5), (11, 3), (2, 4), (0, 3)])
def test_balanced_split(spark, n, parts):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(n)], "id int")
    got = [p for _, p in sorted((r.id, r.part) for r in R.balanced_split(df, parts, "id").collect())]
    small, large = divmod(n, parts)
    assert got == [p + 1 for p in range(parts) for _ in range(small + (p < large))]


def test_batches_and_positions(spark):
    df = spark.createDataFrame([(1, 0), (2, 3), (3, None), (4, 3)], "o int, p int")
    assert rows(R.select_batch(df, "p", "o", 3), "o", "batch_position") == [(1, 3), (2, 1), (4, 2)]
    assert rows(R.positions(df, "p", ["o"]).where("p = 3"), "o", "position") == [(2, 1), (4, 2)]


def test_joins(spark):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z")], "k string, n int, s string")
    assert rows(R.with_default(left, right, "k", ["n"], {"s": F.lit("review")}), "k", "s") == sorted([("a", "y"), ("b", "review"), (None, "review")], key=repr)
    base = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, s string")
    assert rows(R.override(base, spark.createDataFrame([("a", "9"), ("b", None)], "k string, s string"), "k", "s"), "k", "s") == [("a", "9"), ("b", "2")]
    assert rows(R.set_differences(base.select("k"), left, ["k"]), "k", "left_rows", "right_rows") == [(None, 0, 1)]
    claims = spark.createDataFrame([(1, "u", "b c", "s"), (2, "u", "x", "s"), (3, "v", "b", "s"), (4, "u", " ", "s"), (5, None, "b", "s")], "claim_id int, url string, quote string, scope string")
    pages = spark.createDataFrame([("u", "a b c", "s"), ("u", "b c d", "s"), ("v", None, "s")], "url string, text string, scope string")
    answered = pages.withColumns({"status_code": F.lit(200), "content_quality": F.lit(None).cast("string")})
    assert rows(R.evidence(claims, answered), "claim_id") == [(1,)]
    spaced = spark.createDataFrame([(1, "u", " b\u3000 c\u200b"), (2, "u", "b c\ufffd"), (3, "w", "b c"), (4, "x", "b c"), (5, "y", "b c"), (6, "z", "b c")], "claim_id int, url string, quote string")
    odd = [("u", "a b\n c", 299, "ok"), ("w", "b c", 404, "ok"), ("x", "b c", None, "ok"), ("y", "b c", 200, " Unresolved"), ("z", "b c" + "\ufffd" * 4, 200, None)]
    assert rows(R.evidence(spaced, spark.createDataFrame(odd, "url string, text string, status_code int, content_quality string")), "claim_id") == [(1,)]
    named = spark.createDataFrame([(1, None, "b c", "s"), (2, None, "a b c", "s"), (3, "v", "a b", "s"), (4, "u", "a b", "s"), (5, "", "zz", "s"), (6, None, None, "s"), (7, None, "a b", None)], "claim_id int, url string, quote string, scope string")
    assert rows(R.locate(named, pages, "scope")) == [(1, 2, None, "many"), (2, 1, "u", "one"), (3, 1, None, "elsewhere"), (4, 1, "u", "named"), (5, 0, None, "none"), (6, 0, None, "none"), (7, 0, None, "none")]


def test_aggregates(spark):
    df = spark.createDataFrame([("a", "x", 1, "accepted"), ("a", "y", 2, "review"), ("b", "x", 3, None), ("a", "y", 4, "accepted"), (None, "y", 5, "accepted")], "k string, run string, o int, s string")
    assert rows(R.counts_with_zeros(df, "s", ["accepted", "review", "blocked"])) == [("accepted", 3), ("blocked", 0), ("review", 1)]
    good = F.col("s") == "accepted"
    assert rows(R.merge_runs(df, "k", "run", "o", good), "k", "o") == [("a", 1)]
    assert rows(R.run_conflicts(df, "k", good)) == [("a", 2, 1)]
    assert rows(R.run_counts(df, "k", "run", "o", good)) == [("x", 1, 1, 0), ("y", 1, 0, 1)]
    assert rows(R.coverage(df, "k", "run", ["x", "y"])) == sorted([("a", "", True), ("b", "y", False), (None, "x", False)], key=repr)
    assert rows(R.reuse(df, "k", 2)) == [("a", 3)]
    assert rows(R.precision(df, good, 0.5)) == [(5, 3, 0.6, True)] and rows(R.precision(df.limit(0), good, 0.5)) == [(0, 0, None, False)]
    lists = spark.createDataFrame([("a", 1, "u", ["x", "x", None]), ("a", 0, "v", ["x", "y"]), ("b", 2, "w", None)], "k string, o int, url string, items array<string>")
    assert rows(R.first_sources(lists, "k", "items", "o", "url"), "k", "item", "url") == [("a", "x", "v"), ("a", "y", "v")]


def test_quality_sample_is_round_robin(spark):
    import hashlib

    rng = random.Random(7)
    data = [(f"https://{i}.é", rng.choice(["b", "a", None, "c"]), rng.choice([0, 0, 1, 2])) for i in range(40)]
    df = spark.createDataFrame(data, "url string, kind string, hard int")
    sha = lambda r: hashlib.sha256(r[0].encode()).hexdigest()
    for size in (1, 5, 12, 39, 40, 60):
        got = {r.url for r in R.quality_sample(df, size, "hard", "kind", "url").collect()}
        if size >= len(data):
            want = {r[0] for r in data}
        else:
            hard = sorted((r for r in data if r[2]), key=lambda r: (-r[2], sha(r)))[: math.ceil(size / 2)]
            groups = {}
            for r in sorted(set(data) - set(hard), key=sha):
                groups.setdefault(r[1] or "未分類", []).append(r)
            order = sorted((i, k, r[0]) for k, g in groups.items() for i, r in enumerate(g))
            want = {r[0] for r in hard} | {u for _, _, u in order[: size - len(hard)]}
        assert got == want


def test_links(spark):
    links = [("p", 1, "https://a/about", "/about", "About", None), ("p", 2, "https://a/menu", "/menu", "Food menu", None), ("p", 3, "https://a/drinks", "/drinks", "Matcha menu", None),
             ("p", 4, "https://a/f", "/f", None, "frame"), ("p", 5, "https://a/company", "/company", None, None), ("p", 6, "https://a/privacy-contact", "/privacy-contact", "", None),
             ("p", 7, "https://a/cookie-policy-products", "/cookie-policy", "products", None), ("p", 8, "https://a/cookies", "/products/cookies", "Cookies", None), ("p", 9, "https://a/f", "/f", None, "frame")]
    df = spark.createDataFrame(links, "page_id string, link_ord int, url string, path string, text string, kind string")
    got = [r.url for r in L.priority_links(df, L.HOSPITALITY_ORDER).orderBy("position").collect()]
    assert got == ["https://a/f", "https://a/about", "https://a/drinks"]
    assert [r.url for r in L.priority_links(df).orderBy("position").collect()] == ["https://a/f", "https://a/about", "https://a/cookies"]


def test_map_elements(spark):
    data = [(1, "node", 1, {"website": "https://www.acme.com/a", "name": "Acme", "shop": "tea", "addr:city": "Kofu"}), (2, "way", 2, {"contact:website": "acme.com", "cuisine": "sushi; japanese"}),
            (3, "node", 3, {"website": "facebook.com/x"}), (4, "node", -1, {"website": "b.com"}), (5, "area", 5, {"website": "c.com"}), (6, "node", 6, None), (7, "node", 7, {"website": "", "contact:website": "d.com", "brand": "D"})]
    df = spark.createDataFrame(data, "ord int, type string, id bigint, tags map<string,string>")
    got = O.collapse(df, O.parse_tags(["shop=tea", "cuisine=japanese"]))
    assert rows(got, "company", "url", "name", "address", "locations", "matched_tags", "source_url") == [
        ("acme.com", "https://www.acme.com/", "Acme", "Kofu", 2, ["shop=tea", "cuisine=japanese"], "https://www.openstreetmap.org/node/1"),
        ("d.com", "https://d.com/", "D", "", 1, [], "https://www.openstreetmap.org/node/7"),
    ]
    text = O.overpass_query(O.parse_tags(["shop=tea", "cuisine=steak.house"]), "US-CA", 60)
    assert text.count("nwr[") == 4 and '["cuisine"~"(^|;) *steak[.]house *(;|$)"]' in text and "[timeout:60]" in text
    for bad in ('shop=te"a', "shop=", "a b=c"):
        with pytest.raises(ValueError):
            O.parse_tags([bad])


def test_search(spark):
    page = json.dumps({"web": {"results": [{"url": "https://yelp.com/x", "title": "T"}, {"url": "ftp://x"}, {"url": "https://a.example", "description": "d"}]}})
    df = spark.createDataFrame([("q", 0, page), ("q", 1, page), ("r", 0, None), ("s", 0, "{bad")], "query string, page int, payload string")
    assert rows(ranked_results(df, 20), "query", "rank", "title", "directory_like") == [("q", 1, "T", True), ("q", 21, "T", True), ("q", 23, "", False), ("q", 3, "", False)]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.json").write_text('\ufeff["x.example", {"url":"https://y.example","priority":3}, {"url":"https://z:tel"}, {"priority":true}]', encoding="utf-8")
    (tmp_path / "b.json").write_text('[{"url":"w.example","priority":"2.5"}]')
    elements = J.json_elements(spark, [str(tmp_path / "b.json"), str(tmp_path / "a.json")])
    good, bad = J.candidate_list(elements)
    assert rows(good, "file_ordinal", "pos", "canonical", "priority") == [(0, 0, "https://w.example/", 0), (1, 0, "https://x.example/", 0), (1, 1, "https://y.example/", 3)]
    assert rows(bad, "pos") == [(2,), (3,)]
    assert rows(J.json_array(spark, [str(tmp_path / "b.json")], "url string"), "pos", "url") == [(0, "w.example")]
    (tmp_path / "c.json").write_text("{}")
    with pytest.raises(Exception, match="not a JSON array"):
        J.json_elements(spark, [str(tmp_path / "c.json")]).collect()
    df = spark.createDataFrame([("a,\"b\"", None), ("c\nd", 2)], "`会社名` string, n int")
    assert write_report(df, str(tmp_path / "r.csv")) == 2
    assert rows(J.csv_rows(spark, str(tmp_path / "r.csv"), "会社名")) == [('a,"b"', None), ("c\nd", "2")]
    assert report_csv([("x", None)], ["h", "i"]) == b"\xef\xbb\xbfh,i\r\nx,\r\n"
    write_json(df, str(tmp_path / "j"))
    assert any('"n":null' in r.value for r in spark.read.text(str(tmp_path / "j")).collect())
    write_parts(df.withColumn("part", F.lit(1)), str(tmp_path / "p"), "part")
    assert (tmp_path / "p" / "part=1").is_dir()
    keyed = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), (None, 3, "x")], "k string, n int, v string")
    assert rows(J.latest_by_key(keyed, "k", ["n"]), "v") == [("new",)]
    robots = spark.createDataFrame([("User-agent: *\nDisallow: /x", 200, "https://a/x"), ("User-agent: *\nDisallow: /x", 200, "https://a/y"), (None, 403, "https://a/"), (None, 500, "https://a/")], "r string, s int, u string")
    assert [r[0] for r in robots.select(J.robots_allow(F.col("r"), F.col("s"), F.col("u"), "me")).collect()] == [False, True, False, True]


def test_snapshots_and_resume(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    assert store.current() is None
    work = spark.createDataFrame([(1,), (2,)], "id int")
    seen = []

    def step(df):
        seen.append(df.count())
        return df.withColumn("done", F.lit(True))

    parts = Parts(spark, str(tmp_path / "p"))
    assert parts.current() is None and resume(work, ["id"], parts, step).count() == 2
    assert resume(work.unionByName(spark.createDataFrame([(3,)], "id int")), ["id"], parts, step).count() == 3 and seen == [2, 1]
    for n in (2, 3, 3):
        store.publish(spark.range(n))
    with pytest.raises(Exception):
        store.publish(work.select(F.raise_error(F.lit("lost"))))
    assert len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("v-")]) == 3  # the current, the one before, and the lost one
    assert store.current().count() == 3 and remaining(work, store.current(), ["id"]).count() == 0


def test_streams(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "url string, at timestamp, text string"
    first = spark.sql("SELECT 'u' AS url, timestamp'2025-01-01 00:00:00' AS at, 'old' AS text UNION ALL SELECT 'v', timestamp'2025-01-01 00:01:00', 'x'")
    first.write.parquet(source)
    store = NewestRows(spark, str(tmp_path / "t"), ["url"], ["at"], buckets=8)
    run = lambda: keep_newest(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "c")).awaitTermination()
    run()
    before = store._state()
    spark.sql("SELECT 'u' AS url, timestamp'2025-01-02 00:00:00' AS at, 'new' AS text").write.mode("append").parquet(source)
    run()
    assert rows(store.current(), "url", "text") == [("u", "new"), ("v", "x")] and sum(before[k] != v for k, v in store._state().items()) == 1
    store.merge(spark.sql("SELECT 'u' AS url, timestamp'2025-01-01 12:00:00' AS at, 'late' AS text"))
    assert rows(store.current(), "url", "text") == [("u", "new"), ("v", "x")]
    counted = arrivals(spark.readStream.schema(schema).parquet(source), "at", "1 hour", "1 day", "url")
    q = counted.writeStream.format("memory").queryName("arrivals").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(rows) FROM arrivals").first()[0] == 3


def test_spread(spark, tmp_path):
    from gneiss.session import spread

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(1000).repartition(8).write.parquet(str(tmp_path / "many"))
    one, many = (spark.read.parquet(str(tmp_path / n)) for n in ("one", "many"))
    assert spread(one) is one  # too few bytes for a second task
    wide = spark.range(600_000).selectExpr("id", "sha2(string(id), 512) AS s").coalesce(1)
    wide.write.parquet(str(tmp_path / "wide"))
    wide = spark.read.parquet(str(tmp_path / "wide"))
    assert spread(wide).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism and spread(wide).count() == 600_000
    assert spread(many) is many


def test_positions_across_ranges(spark):
    df = spark.createDataFrame([("hot" if i % 3 else f"g{i % 7}", i) for i in range(500)] + [(None, 1), (None, 2)], "g string, o int")
    got = {(r.g, r.o): r.position for r in R.positions(df, "g", ["o"]).collect()}
    groups = {}
    for g, o in sorted(got, key=lambda x: (x[0] or "", x[1])):
        groups.setdefault(g, []).append(o)
    assert len(got) == 502 and all(got[g, o] == n + 1 for g, items in groups.items() for n, o in enumerate(items))


def test_required_sets(spark):
    from gneiss.operators import checks as C

    df = spark.createDataFrame([(1, "a", "ok"), (1, " b ", "no"), (2, "a", "ok"), (2, "a", "ok"), (2, "c", "ok"), (3, None, None), (4, "b", "odd"), (4, "a", None), (9, "a", "ok")], "k int, t string, r string")
    owners = spark.createDataFrame([(k, ["a", "b", " "]) for k in range(1, 6)] + [(6, []), (7, None), (8, ["a"])], "k int, wanted array<string>")
    got = rows(C.required_set(df, "k", "t", "r", owners, ["ok", "no"]))
    assert got == [(2, "a", "duplicate"), (2, "b", "missing"), (2, "c", "unknown"), (3, "a", "missing"), (3, "b", "missing"), (4, "a", "invalid"), (4, "b", "invalid"), (5, "a", "missing"), (5, "b", "missing"), (8, "a", "missing")]
    assert rows(C.all_reused(df, "k", "t", 5)) == [(9, 5)] and rows(C.all_reused(df, "k", "t", 6)) == []


def test_link_functions_agree(spark):
    links = [("/about", "x"), ("/menu/drinks", "Food"), ("/p", "How we use cookies"), ("/cookie-einstellungen", None), ("/agb", "contact"), ("/卸", ""), ("/x", None), ("/access", "アクセス")]
    df = spark.createDataFrame(links, "p string, t string")
    group = L.link_group(F.col("p"), F.col("t"))
    got = [tuple(r) for r in df.select(group, F.when(group.isNotNull(), L.link_score(group, F.col("p"), F.col("t")))).collect()]
    assert got == [("about", 0), ("menu", 9), (None, None), (None, None), (None, None), ("distribution", 0), (None, None), ("locations", 0)]


def test_crawl_replay(spark):
    from gneiss.operators.frontier import replay

    home = '<a href="/about">About</a><a href="/contact">Contact</a><a href="/shop/products">Products</a><a href="https://forms.example/contact?x">Form</a><iframe src="/frame"></iframe><a href="/about">again</a>'
    about = '<a href="/company/history">Company</a><a href="/agb">AGB</a>'
    pages = [("https://a.example/", None, 200, home), ("https://a.example/about", "https://a.example/about", 200, about), ("https://a.example/company/history", None, 404, None),
             ("https://a.example/frame", "https://other.example/", 200, ""), ("https://b.example/", "https://b.example/", 503, "")]
    stored = spark.createDataFrame(pages, "url string, final_url string, status int, html string")
    starts = spark.createDataFrame([("a", "a.example"), ("b", "https://b.example"), ("c", "https://c:tel"), ("d", "https://d.example")], "company string, url string")
    got = rows(replay(starts, stored), "company", "attempt", "requested", "outcome")
    assert got == [
        ("a", 1, "https://a.example/", "page"), ("a", 2, "https://a.example/about", "page"), ("a", 3, "https://a.example/company/history", "status"),
        ("a", 4, "https://a.example/frame", "out of scope"), ("a", 5, "https://a.example/shop/products", "missing"), ("b", 1, "https://b.example/", "status"), ("d", 1, "https://d.example/", "missing"),
    ]
    assert [r.contacts for r in replay(starts, stored, attempts=1).where("company = 'a'").collect()] == [["https://forms.example/contact?x"]]
    assert replay(starts.limit(0), stored).count() == 0


def test_replayed_home_links_to_more_than_one_page_of_a_group(spark, tmp_path):
    from gneiss.plans.leads import crawl_replay

    home = "https://a.example/about-tea"
    urls = [home, "https://a.example/company", "https://a.example/product/a", "https://0.example/contact", "https://a.example/contact"]
    rows_ = [(i, u, home, 200) for i, u in enumerate(urls)]
    spark.createDataFrame(rows_, "crawl_id bigint, url string, canonical_url string, status_code int").write.parquet(f"{tmp_path}/crawls.parquet")
    got = {r.requested for r in crawl_replay(spark, str(tmp_path)).collect()}
    assert got == {home, "https://a.example/company", "https://a.example/product/a", "https://a.example/contact"}


def test_campaigns(spark):
    from gneiss.operators import campaigns as P

    shape = ("campaign_id string, research_mode string, product struct<name:string,keywords:array<string>>, market struct<name:string,keywords:array<string>>, product_evidence struct<rule:string,summary_ja:string>, "
             "objective string, buyer_types array<struct<name:string,keywords:array<string>>>, target_accepted int, max_candidates int, batch_size int, max_pages_per_company int")
    good = ("a", "batch", ("tea", ["tea", " tea ", "", None]), ("US", ["US"]), ("can_use", "x"), None, [("Importer", ["Coffee shop"])], 1000, 5000, 100, 5)
    bad = ("b", None, (None, []), None, None, "sell", None, 60, 50, 500, 6)
    df = spark.createDataFrame([good, bad], shape)
    assert rows(P.keywords(df)) == [("a", "tea")]
    assert [r.groups[1] for r in P.link_order(df).orderBy("campaign_id").collect()] == ["menu", "products"]
    assert {r.fault for r in P.faults(df).collect() if r.campaign_id == "b"} == {
        "product.name", "product.keywords", "market.name", "market.keywords", "buyer_types", "product_evidence.rule", "product_evidence.summary_ja", "target_accepted", "max_candidates", "max_pages_per_company"}
    assert P.faults(df.where("campaign_id = 'a'")).count() == 0
    more = df.withColumn("product_evidence", F.struct(F.lit("can_use").alias("rule"), F.lit("x").alias("summary_ja"), F.array(F.lit("latte"), F.lit("tea")).alias("prescreen_keywords")))
    assert rows(P.keywords(more)) == [("a", "latte"), ("a", "tea"), ("b", "latte"), ("b", "tea")]


def test_labels_survive_a_new_report(spark, tmp_path):
    path = str(tmp_path / "r.csv")
    first = spark.createDataFrame([("u1", "A", ""), ("u2", "B", "")], "url string, name string, verdict string")
    assert write_labelled_report(first, path, "url", ("verdict", "notes")) == 2
    text = open(path, encoding="utf-8-sig", newline="").read()
    assert text == "url,name,verdict,notes\r\nu1,A,,\r\nu2,B,,\r\n"
    open(path, "w", encoding="utf-8-sig", newline="").write(text.replace("u2,B,,", 'u2,B,ok,"a\n""b"""'))
    write_labelled_report(spark.createDataFrame([("u2", "B2"), ("u3", "C")], "url string, name string"), path, "url", ("verdict", "notes"))
    assert rows(J.csv_rows(spark, path, "url"), "url", "name", "verdict", "notes") == [("u2", "B2", "ok", 'a\n"b"'), ("u3", "C", None, None)]


def test_evaluation_refuses_what_is_not_labelled(spark):
    df = spark.createDataFrame([("good",)] * 27 + [("bad",)] * 3, "v string")
    assert rows(R.evaluated(df, "v", "good", "bad", 30, 0.9)) == [(30, 27, 0.9, True)]
    for sample, expected in ((df, 29), (df.limit(29).unionByName(spark.createDataFrame([("",)], "v string")), 30), (df.limit(29).unionByName(spark.createDataFrame([(None,)], "v string")), 30)):
        with pytest.raises(ValueError):
            R.evaluated(sample, "v", "good", "bad", expected, 0.9)


def test_map_answers_are_refused_whole(spark):
    good = {"type": "node", "id": 1, "tags": {"shop": "tea"}}
    bad = [{}, {"elements": {}}, {"elements": [good], "remark": "timeout"}, {"elements": [good, 1]}, {"elements": [good | {"id": True}]}, {"elements": [good | {"id": 0}]}, {"elements": [good | {"tags": {"a": 1}}]}, {"elements": [good | {"type": "area"}]}]
    payloads = [("g", json.dumps({"elements": [good, good | {"id": 2}]})), ("e", '{"elements":[]}'), ("n", None), ("x", "{")] + [(f"b{i}", json.dumps(b)) for i, b in enumerate(bad)]
    df = spark.createDataFrame(payloads, "source string, payload string")
    assert rows(O.payload_elements(df), "source", "ord", "id") == [("g", 0, 1), ("g", 1, 2)]
    assert [O.payload_fault(p) for _, p in payloads[:6]] == [None, None, "no elements", "unreadable", "no elements", "no elements"]


def test_failed_queries_and_ordered_files(spark, tmp_path):
    from gneiss.operators.search import query_failures

    df = spark.createDataFrame([("a", 0, 200, '{"web":{"results":[]}}'), ("b", 0, 401, None), ("c", 0, 200, '{"web":{}}'), ("c", 1, 500, None), ("d", 0, 200, "{bad"), ("e", 0, None, None)], "query string, page int, status int, payload string")
    assert rows(query_failures(df)) == [("b", "refused"), ("c", "failed"), ("d", "unreadable"), ("e", "failed")]
    for name in ("b", "a"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "crawls.json").write_text(json.dumps([{"k": "x", "v": name}]))
    paths = J.glob_paths(spark, f"{tmp_path}/*/crawls.json")
    assert [p[-13:-12] for p in paths] == ["a", "b"] and J.glob_paths(spark, f"{tmp_path}/none/*") == []
    assert rows(J.latest_by_key(J.json_array(spark, paths, "k string, v string"), "k", ["file_ordinal", "pos"]), "v") == [("b",)]


def test_forms_come_before_links(spark):
    pages = spark.createDataFrame([("a", 2, "u2", True, 200, "readable"), ("a", 1, "u1", True, 200, " Readable"), ("a", 3, "u1", True, 200, "readable"), ("a", 4, "u4", False, 200, "readable"), ("a", 5, "u5", True, 404, "readable"), ("b", 1, None, True, 200, "readable")],
                                  "company string, o int, url string, has_form boolean, status_code int, content_quality string")
    visits = spark.createDataFrame([("a", 1, ["x", "y"]), ("a", 2, ["x", "w"]), ("b", 1, [])], "company string, attempt int, contacts array<string>")
    assert rows(R.contact_forms(pages, visits, "company", "o"), "company", "position", "url") == [("a", 1, "u1"), ("a", 2, "u2"), ("a", 3, "x"), ("a", 4, "y"), ("a", 5, "w")]


def test_market_readings():
    import re

    from gneiss.functions import evidence as E

    cases = {"Reno NV 89501": "screen audit draft", "made in Oregon": "audit draft", "Portland, or": "draft", "the US": "audit draft", "Q.X": "screen audit draft", "the usa": "", "QxX": ""}
    for text, want in cases.items():
        assert [r for r in E.MARKETS if re.search(E.market_pattern(["Q.X"], r), text)] == want.split()


def test_targets():
    from gneiss.functions.url import refused_target

    assert refused_target("https://example.com/x") is None and refused_target("http://example.com:443", ("93.184.216.34",)) is None
    reasons = [refused_target(u, a) for u, a in [("https://a:tel/", ()), ("ftp://a.com", ()), ("https://a.com:8080", ()), ("http://localhost", ()), ("http://127.0.0.1", ()), ("http://10.0.0.8/", ()), ("https://a.com", ("192.168.0.1",))]]
    assert reasons == ["unreadable", "scheme", "port", "local", "not global", "not global", "not global"]


def test_fetch_choice(spark):
    from gneiss.operators.fetched import choose_fetch

    long, ld = "word " * 60, '<script type="application/ld+json">{"@type":"PostalAddress","streetAddress":"1 Pier"}</script>'
    shape = "url string, final_url string, status int, html string, text string, visible_text string"
    plain = spark.createDataFrame([("a", "a", 200, ld, "short", "short"), ("b", "b", 200, "", long, long), ("c", "c", 403, "", "", ""), ("d", "d", 500, ld, "", ""), ("e", "e", 200, ld, "x", "x"), ("f", None, None, None, None, None)], shape)
    rendered = spark.createDataFrame([("a", "a", 200, "", "full", "full"), ("b", "b", 200, "", "full", "full"), ("c", "c", 200, "", "full", "full"), ("d", "d", 200, "", "full", "full"), ("e", "z", 200, "", "full", "full")], shape)
    got = {r.url: (r.fetched_with, r.text and r.text.strip()) for r in choose_fetch(plain, rendered).collect()}
    assert got == {"a": ("rendered", "full [structured data address] 1 Pier"), "b": ("plain", long.strip()), "c": ("plain", ""), "d": ("rendered", "full"), "e": ("rendered", "full"), "f": ("plain", None)}
