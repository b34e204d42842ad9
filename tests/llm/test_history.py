import random

import pytest
from pyspark.sql import functions as F

from gneiss.llm.history import History, company_key, duplicates, keyed_rows, split_address, tenant_of

TENANTS = {"pages.host.example": "", "sites.host.example": "~", "town.hostnet.example": "ent/"}


@pytest.mark.parametrize(
    "address,host",
    [
        ("https://www.A-b.Example./x?y#z", "ab.example"), ("HTTP://u:p@ａｂ．example:443/", "ab.example"), ("ab.example", "ab.example"),
        ("\t\u3000//ab.example:/x ", "ab.example"), ("ab.example\\x", "ab.example"), ("https://ab.example:tel/", None), ("tel:000-5550", None),
        ("mailto:me@ab.example", None), ("https://", None), ("n/a", None), ("", None), ("www.example", "www.example"), ("a b.example", None), ("a..example", None),
    ],
)
def test_hosts(address, host):
    found = split_address(address)
    assert (found and found[0]) == host


def test_tenants():
    assert tenant_of("/a%2Db/x", "") == "a-b"
    assert tenant_of("/news/%252e%252e/t/", "") == "t"
    assert tenant_of("\\t\\x", "") == "t"
    assert tenant_of("/~t/x", "~") == "t" and tenant_of("/t", "~") == ""
    assert tenant_of("/ent/t/x", "ent/") == "t" and tenant_of("/ent/", "ent/") == "" and tenant_of("/t;v=2", "") == "t"
    assert company_key("https://www.Town.Host-Net.example/./ent/t", TENANTS) == "/town.hostnet.example/t"
    assert company_key("https://pages.host.example/", TENANTS) is None


def brute(rows, tenants):
    keys = {}
    for i, url, domain in rows:
        key = company_key(url, tenants) or company_key(domain, tenants)
        if i is not None and key:
            keys.setdefault(i, key)
    present = set(keys.values())

    def root(k):
        parts = k.split(" ")
        return k if k[0] == "/" else next(p for n in range(1, len(parts) + 1) if (p := " ".join(parts[:n])) in present)

    first, out = {}, set()
    for i in sorted(keys):
        r = root(keys[i])
        if r in first:
            out.add((first[r], i))
        first.setdefault(r, i)
    return out


def frames(spark, rows):
    df = spark.createDataFrame([(i, u, d, "x", "y") for i, u, d in rows], "candidate_id bigint, url string, domain string, key string, id string")
    shared = spark.createDataFrame([(h.replace("hostnet", "host-net"), p) for h, p in TENANTS.items()], "host string, tenant_prefix string")
    return df, shared


def random_rows(n, seed):
    rng = random.Random(seed)
    hosts = [f"{s}{a}.{t}" for s in ("", "m.", "x.m.", "www.") for a in "abcdefgh" for t in ("example", "co.example")]
    rows = []
    for i in range(n):
        u = "https://hot.example/" if rng.random() < 0.33 else rng.choice(["https://", "", "HTTP://"]) + rng.choice(hosts) + "/p"
        u = rng.choice([u, u, u, None, "n/a", f"https://pages.host.example/{rng.choice('rst')}"])
        rows.append((i * 3 % 1009, u, rng.choice(hosts + [None, ""])))
    return rows


def test_agrees_with_brute_force(spark):
    rows = random_rows(900, 2)
    df, shared = frames(spark, rows)
    got = {(r.first_id, r.candidate_id) for r in duplicates(df, shared).collect()}
    assert got == brute(rows, TENANTS) and len(got) > 500


def test_nulls_and_empty(spark):
    rows = [(None, "https://a.example", None), (1, None, None), (2, "https://a.example", None), (2, "https://a.example", None), (3, "", "a.example")]
    df, shared = frames(spark, rows)
    assert [(r.first_id, r.candidate_id) for r in duplicates(df, shared).collect()] == [(2, 3)]
    assert duplicates(df.limit(0), shared).count() == 0


def admitted(history, df, shared, low, high):
    """Rows known on arrival of one batch of ids."""
    batch = keyed_rows(df.where(F.col("candidate_id").between(low, high)), shared, "candidate_id", "url", "domain")
    found, changed = history.admit(batch)
    return {(r.first_id, r.id) for r in found.collect() if r.id > r.first_id}, found, changed


def test_batches_against_persisted_runs(spark, tmp_path):
    rows = sorted(random_rows(600, 4), key=lambda r: r[0])
    df, shared = frames(spark, rows)
    history = History(spark, f"{tmp_path}/h", fan=2, range_keys=5)
    seen, parts = [], []
    for low in range(0, 1009, 200):
        got, *both = admitted(history, df, shared, low, low + 199)
        parts.append(both)
        seen += [r for r in rows if low <= r[0] < low + 200]
        assert got == {p for p in brute(seen, TENANTS) if low <= p[1] < low + 200}
        history = History(spark, f"{tmp_path}/h", fan=2, range_keys=5)  # a new driver
    assert sorted(r["tier"] for r in history.runs) == [1, 2] and len(history.runs[-1]["files"]) + len(history.runs[0]["files"]) > 4
    assert {p.name for p in (tmp_path / "h").iterdir() if p.is_dir()} == {r["path"].rsplit("/", 1)[1] for r in history.runs}
    found, changed = parts[0]
    for f, c in parts[1:]:
        found, changed = found.unionByName(f), changed.unionByName(c)
    assert {(r.first_id, r.id) for r in history.settle(found, changed).collect()} == brute(rows, TENANTS)
    history.drop()
    assert not (tmp_path / "h").exists()


def test_a_lost_driver_loses_no_key_and_overwrites_no_run(spark, tmp_path):
    df, shared = frames(spark, [(1, "a.example", None), (2, "b.example", None), (3, "a.example", None), (4, "x.b.example", None)])
    admitted(History(spark, f"{tmp_path}/h"), df, shared, 1, 2)
    history = History(spark, f"{tmp_path}/h")
    before = [r["path"] for r in history.runs]
    write = history._publish
    history._publish = lambda runs: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        admitted(history, df, shared, 3, 4)
    history._publish = write
    again = History(spark, f"{tmp_path}/h")
    assert [r["path"] for r in again.runs] == before
    assert admitted(again, df, shared, 3, 4)[0] == {(1, 3), (2, 4)}
    assert admitted(History(spark, f"{tmp_path}/h"), df, shared, 3, 4)[0] == {(1, 3), (2, 4)}  # a batch that comes twice
    assert {r.key: r.first_id for r in History(spark, f"{tmp_path}/h").read().groupBy("key").agg(F.min("first_id").alias("first_id")).collect()} == {"example a": 1, "example b": 2, "example b x": 4}


def test_reads_follow_the_batch_and_not_the_history(spark, tmp_path):
    def batch(numbers, first):
        return spark.createDataFrame([(first + i, f"uk co h{n:05d}") for i, n in enumerate(numbers)], "id bigint, key string")

    read = []
    for size in (1_000, 10_000):
        history = History(spark, f"{tmp_path}/{size}", range_keys=100)
        history.admit(batch(range(0, 2 * size, 2), 0))
        files = history.files
        history.files = lambda spans: read.append((size, found := files(spans))) or found
        found, _ = history.admit(batch(range(501, 521, 2), 50_000).union(batch([506], 60_000)))
        assert [(r.first_id, r.id) for r in found.where("id > first_id").collect()] == [(253, 60_000)]
    assert max(len(f) for _, f in read) <= 4 and len(History(spark, f"{tmp_path}/10000").runs[0]["files"]) > 50


def test_many_shared_hosts_are_joined(spark):
    df, shared = frames(spark, random_rows(300, 12))
    held, joined = (sorted(map(tuple, keyed_rows(df, shared, "candidate_id", "url", "domain", most=m).select("id", "key").collect())) for m in (10, 1))
    assert held == joined and any(k.startswith("/pages") for _, k in held)


def test_siblings_below_a_known_root_keep_the_first_id(spark, tmp_path):
    rng = random.Random(6)
    hosts = [s + a for s in ("", "shop.", "en.", "m.", "x.shop.", "y.shop.") for a in ("b.example", "c.co.example", "d.example")]
    rows = [(5, "a.e.example", None), (10, "e.example", None), (220, "c.e.example", None)]
    rows += [(i, rng.choice(hosts), None) for i in rng.sample(range(20, 1000), 60)]
    df, shared = frames(spark, rows)
    history = History(spark, f"{tmp_path}/h", fan=2, range_keys=3)
    seen = []
    for low in range(0, 1000, 200):
        got = admitted(history, df, shared, low, low + 199)[0]
        seen += [r for r in rows if low <= r[0] < low + 200]
        assert got == {p for p in brute(seen, TENANTS) if low <= p[1] < low + 200}
        assert low != 200 or (5, 220) in got


@pytest.mark.parametrize("group", [40, 1000])
def test_rows_do_not_depend_on_the_grouping_of_batches(spark, group):
    rng = random.Random(9)
    rows = [(i, u, d) for i, u, d in {r[0]: r for r in random_rows(200, 8)}.values()]
    rows += [(2000, "m.z.example", None), (2001, "z.example", None), (2002, "x.z.example", None), (2003, "m.z.example", None)]
    batch_of = {r[0]: rng.randrange(8) for r in rows} | {2000: 3, 2001: 5, 2002: 4, 2003: 4}
    df, shared = frames(spark, rows)
    df = df.join(spark.createDataFrame(list(batch_of.items()), "candidate_id bigint, at bigint"), "candidate_id")
    want = set()
    for b in range(8):
        want |= {p for p in brute([r for r in rows if batch_of[r[0]] <= b], TENANTS) if batch_of[p[1]] == b}
    run = lambda settled: {(r.first_id, r.candidate_id) for r in duplicates(df, shared, batch=F.col("at"), at_once=group, settled=settled).collect()}
    got = run(False)
    assert got == want and (2000, 2003) in got and all(i != 2002 for _, i in got)
    assert run(True) == brute(rows, TENANTS)  # late roots, and ids that come in no order
