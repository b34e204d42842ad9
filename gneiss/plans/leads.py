"""Queries of the evidence pipeline over crawls, audits, candidates and records, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions import evidence as E
from gneiss.functions import text as T
from gneiss.functions.html import parsed_page
from gneiss.functions.url import SKIPPED_HOSTS, plain_host, record_company, refused_target, same_site_columns, url_identity, with_identity
from gneiss.operators import campaigns as P
from gneiss.operators import checks as C
from gneiss.operators import links as L
from gneiss.operators import osm as O
from gneiss.operators import relations as R
from gneiss.operators.fetched import choose_fetch
from gneiss.operators.frontier import replay
from gneiss.operators.nested import child_table
from gneiss.operators.search import DIRECTORY_HOSTS, directory_like, ranked_results
from gneiss.plans.nested import field_sql, of_list, walk_sql
from gneiss.session import shared_dir, spread, table
from gneiss.sources.sinks import NewestRows
from gneiss.streaming.incremental import arrivals, keep_counts

Query = tuple[str, str | None]
QUERIES: dict = {}
SQL: dict[str, str] = {}
ACCEPTED = "accepted"
CLAIM_TYPES = ("buyer_role", "product", "target_market")
STATUSES = ("accepted", "review", "rejected", "blocked")


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _host_sql(column: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_extract(regexp_replace(lower({column}), '^[\s\p{{Z}}]+', ''), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\.+$', ''), '^www\.', '')"


def _hosted(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "candidates").withColumn("company", plain_host(F.col("url"))).where("company <> ''")


@query(f"SELECT company, min(candidate_id) AS candidate_id, arg_min(url, candidate_id) AS url FROM (SELECT *, {_host_sql('url')} AS company FROM candidates) WHERE company <> '' GROUP BY company")
def company_dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first candidate of each host."""
    return R.first_wins(_hosted(spark, sf).select("company", "candidate_id", "url"), "company", ["candidate_id"])


@query("SELECT host, count(*) AS pages, count(DISTINCT url) AS urls, min(crawl_id) AS first_crawl FROM crawls WHERE host IS NOT NULL GROUP BY host")
def company_page_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "crawls").where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("pages"), F.countDistinct("url").alias("urls"), F.min("crawl_id").alias("first_crawl"))


@query(f"SELECT c.candidate_id, c.company FROM (SELECT candidate_id, {_host_sql('url')} AS company FROM candidates) c WHERE c.company <> '' AND NOT EXISTS (SELECT 1 FROM records r WHERE r.domain = c.company)")
def candidates_excluding_seen(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates whose host has no finished record."""
    seen = table(spark, sf, "records").select(F.col("domain").alias("company"))
    return _hosted(spark, sf).select("candidate_id", "company").join(seen, "company", "left_anti")


@query(
    f"""SELECT audit_id, coalesce(a = b OR ends_with(a, '.' || b) OR ends_with(b, '.' || a), false) AS same_site
    FROM (SELECT audit_id, {_host_sql('canonical_url')} AS a, {_host_sql('evidence_url')} AS b FROM audit WHERE evidence_url IS NOT NULL AND canonical_url IS NOT NULL)"""
)
def evidence_same_site(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a claim's evidence lies on the company's own site."""
    rows = table(spark, sf, "audit").where("evidence_url IS NOT NULL AND canonical_url IS NOT NULL")
    rows = with_identity(with_identity(rows, "canonical_url", "a"), "evidence_url", "b")
    return rows.select("audit_id", same_site_columns(F.col("a"), F.col("b")).alias("same_site"))


@query(f"SELECT candidate_id, company, regexp_matches(company, '(^|[.])(hakoniwa\\.example|borealis\\.test)$') AS directory_like FROM (SELECT candidate_id, {_host_sql('url')} AS company FROM candidates) WHERE company <> ''")
def directory_mark(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates on directory hosts, marked and not dropped."""
    return _hosted(spark, sf).select("candidate_id", "company", directory_like(F.col("url"), ["hakoniwa.example", "borealis.test"]).alias("directory_like"))


def _stripped_sql(column: str) -> str:
    return rf"regexp_replace(regexp_replace({column}, '^[\s\p{{Z}}\x0b\x1c-\x1f]+', ''), '[\s\p{{Z}}\x0b\x1c-\x1f]+$', '')"


def _urls_sql(source: str) -> str:
    """CTEs up to ``urls``: the columns of ``source`` (which has raw) with scheme, host, port, path and query of readable addresses."""
    space = r"[\s\p{Z}\x1c-\x1f\x85]"
    safe = "[A-Za-z0-9_.~/%:@!$&''()*+,;=-]"
    coded = lambda c, more: f"coalesce(array_to_string(list_transform(string_split({c}, ''), lambda x: CASE WHEN regexp_full_match(x, '{safe}{more}') THEN x ELSE url_encode(x) END), ''), '')"
    return rf"""u0 AS (SELECT *, regexp_replace(regexp_replace(raw, '^{space}+', ''), '{space}+$', '') AS s FROM ({source}) WHERE raw IS NOT NULL),
    u1 AS (SELECT *, lower(regexp_extract(s, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS said, regexp_replace(s, '^[A-Za-z][A-Za-z0-9+.-]*:', '') AS rest FROM u0),
    u2 AS (SELECT *, CASE WHEN said = '' THEN 'https' ELSE said END AS scheme, CASE WHEN rest LIKE '//%' THEN regexp_extract(rest, '^//([^/?#]*)', 1) ELSE '' END AS net0,
        regexp_replace(CASE WHEN rest LIKE '//%' THEN regexp_replace(rest, '^//[^/?#]*', '') ELSE rest END, '#.*$', '', 's') AS tail FROM u1),
    u3 AS (SELECT *, regexp_replace(regexp_replace(tail, '\?.*$', '', 's'), ';[^/]*$', '') AS path0, CASE WHEN contains(tail, '?') THEN regexp_replace(tail, '^[^?]*\?', '', 's') ELSE '' END AS query0 FROM u2),
    u4 AS (SELECT *, CASE WHEN net0 = '' THEN regexp_extract(path0, '^([^/]*)', 1) ELSE net0 END AS net,
        CASE WHEN net0 = '' THEN regexp_replace(regexp_replace(path0, '^[^/]*', ''), ';[^/]*$', '') ELSE path0 END AS path1, CASE WHEN net0 = '' THEN '' ELSE query0 END AS query1 FROM u3),
    u5 AS (SELECT *, regexp_replace(net, '^.*@', '') AS spot FROM u4),
    urls AS (SELECT * EXCLUDE (raw, s, said, rest, net0, tail, path0, query0, net, spot, path1, query1), raw, rtrim(lower(regexp_extract(spot, '^([^:]*)', 1)), '.') AS host, regexp_extract(spot, '^[^:]*:(.*)$', 1) AS port,
        {coded("CASE WHEN path1 = '' THEN '/' ELSE path1 END", '')} AS path, {coded('query1', '|[?]')} AS query FROM u5 WHERE rtrim(regexp_extract(spot, '^([^:]*)', 1), '.') <> '' AND regexp_full_match(regexp_extract(spot, '^[^:]*:(.*)$', 1), '[0-9]*'))"""


_AUTHORITY = "host || CASE WHEN port = '' OR (scheme = 'http' AND port::INT = 80) OR (scheme = 'https' AND port::INT = 443) THEN '' ELSE ':' || port::INT END"


@query(
    f"""WITH {_urls_sql("SELECT candidate_id, url AS raw FROM candidates")}
    SELECT c.candidate_id, scheme || '://' || {_AUTHORITY} || CASE WHEN path LIKE '/%' THEN '' ELSE '/' END || path || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical, scheme, host,
    regexp_replace(host, '^www\\.', '') AS domain_key, regexp_replace(host, '^www\\.', '') AS company_key, scheme || '://' || {_AUTHORITY} || '/' AS root_url,
    CASE WHEN host IS NOT NULL THEN false END AS shared, CASE WHEN host IS NOT NULL THEN '' END AS tenant FROM candidates c LEFT JOIN urls u ON u.candidate_id = c.candidate_id"""
)
def url_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical url, company key and root of every candidate."""
    return table(spark, sf, "candidates").select("candidate_id", url_identity(F.col("url")).alias("i")).select("candidate_id", "i.*")


@query(
    r"""SELECT crawl_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)(?:^|[^\p{L}\p{N}_])([a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,})(?:$|[^\p{L}\p{N}_])', 1), lambda x: lower(x)))) AS found
    FROM crawls WHERE text LIKE '%@%'"""
)
def email_extract(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "crawls").where(F.col("text").contains("@")).select("crawl_id", T.emails(F.col("text")).alias("found"))


@query("SELECT crawl_id, length(text) - length(replace(text, chr(65533), '')) AS bad FROM crawls WHERE length(text) - length(replace(text, chr(65533), '')) > greatest(3, length(text) // 50)")
def corrupt_pages(spark: SparkSession, sf: str) -> DataFrame:
    bad = (F.length("text") - F.length(F.replace("text", F.lit(T.REPLACEMENT), F.lit("")))).cast("bigint")
    return table(spark, sf, "crawls").where(T.corrupt(F.col("text"))).select("crawl_id", bad.alias("bad"))


def _usable() -> Column:
    return (F.col("status_code") == 200) & ~F.coalesce(F.lower(F.trim("content_quality")) == "unresolved", F.lit(False)) & (F.trim("text") != "")


_USABLE = "status_code = 200 AND NOT coalesce(lower(trim(content_quality)) = 'unresolved', false) AND trim(text) <> ''"


@query(f"SELECT crawl_id, url FROM crawls WHERE {_USABLE}")
def usable_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "crawls").where(_usable()).select("crawl_id", "url")


@query(
    f"""SELECT c.crawl_id, bool_or(contains(lower(c.text), lower(k))) AS hit FROM (SELECT * FROM crawls WHERE {_USABLE}) c
    JOIN (SELECT campaign_id, unnest(market.keywords) AS k FROM campaigns) m ON m.campaign_id = c.run_name WHERE k <> '' GROUP BY c.crawl_id"""
)
def market_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a usable page names its campaign's market; campaigns are a configuration table of a dozen rows."""
    words = table(spark, sf, "campaigns").select(F.col("campaign_id").alias("run_name"), F.filter("market.keywords", lambda k: k != "").alias("words")).where(F.size("words") > 0)
    pages = table(spark, sf, "crawls").where(_usable()).select("crawl_id", "run_name", F.lower("text").alias("low"))
    return pages.join(words, "run_name").select("crawl_id", F.exists("words", lambda w: F.contains(F.col("low"), F.lower(w))).alias("hit"))


@query()
def prescreen_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """Snippets of each company's pages around words of trade."""
    pages = table(spark, sf, "crawls").where(_usable()).select("canonical_url", "crawl_id", "url", "text")
    return E.keyword_snippets(pages, "canonical_url", "crawl_id", ["wholesale", "distributor", "importer", "private label"])


@query("SELECT candidate_id, CAST(ntile(7) OVER (ORDER BY candidate_id) AS BIGINT) AS part FROM candidates")
def assessor_split(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates in seven contiguous parts of like size."""
    return R.balanced_split(table(spark, sf, "candidates").select("candidate_id"), 7, "candidate_id")


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "audit").select(F.col("audit_id").alias("claim_id"), "canonical_url", F.col("evidence_url").alias("url"), F.col("evidence_text_original").alias("quote"))


def _collapsed_sql(column: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({column}, '[\x{{e000}}-\x{{f8ff}}\x{{200b}}-\x{{200d}}\x{{2060}}\x{{feff}}]', '', 'g'), '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'))"


_EVIDENCE_PAGES = f"""SELECT url, {_collapsed_sql("text")} AS text FROM crawls WHERE status_code BETWEEN 200 AND 299 AND NOT coalesce(lower(trim(content_quality)) = 'unresolved', false)
    AND length(text) - length(replace(text, chr(65533), '')) <= greatest(3, length(text) // 50)"""


@query(
    f"""WITH p AS ({_EVIDENCE_PAGES}), a AS (SELECT audit_id, evidence_url, {_collapsed_sql("evidence_text_original")} AS q FROM audit)
    SELECT audit_id AS claim_id FROM a WHERE q <> '' AND NOT contains(q, chr(65533)) AND EXISTS (SELECT 1 FROM p WHERE p.url = a.evidence_url AND contains(p.text, a.q))"""
)
def claim_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Claims whose quote stands on an evidence page of their url."""
    return R.evidence(_claims(spark, sf), table(spark, sf, "crawls").select("url", "text", "status_code", "content_quality")).select("claim_id")


@query(
    f"""WITH p AS (SELECT canonical_url, coalesce(url, '') AS url, {_collapsed_sql("text")} AS text FROM crawls WHERE {_USABLE}),
    a AS (SELECT audit_id, canonical_url, CASE WHEN audit_id % 2 = 0 THEN evidence_url END AS named, coalesce({_collapsed_sql("evidence_text_original")}, '') AS q FROM audit),
    f AS (SELECT a.audit_id, max(named) AS named, count(p.url) AS pages, coalesce(bool_or(p.url = named), false) AS hit, max(p.url) AS one FROM a LEFT JOIN p ON p.canonical_url = a.canonical_url AND q <> '' AND contains(p.text, q) GROUP BY a.audit_id),
    o AS (SELECT *, CASE WHEN named <> '' THEN CASE WHEN hit THEN 'named' ELSE 'elsewhere' END WHEN pages = 0 THEN 'none' WHEN pages = 1 THEN 'one' ELSE 'many' END AS outcome FROM f)
    SELECT audit_id AS claim_id, pages, CASE WHEN outcome = 'named' THEN named WHEN outcome = 'one' THEN one END AS source, outcome FROM o"""
)
def quote_locate(spark: SparkSession, sf: str) -> DataFrame:
    """Where each quote stands among the usable pages of its company; claims with an even id name their page."""
    claims = _claims(spark, sf).withColumn("url", F.when(F.col("claim_id") % 2 == 0, F.col("url")))
    return R.locate(claims, table(spark, sf, "crawls").where(_usable()).select("canonical_url", "url", "text"), "canonical_url")


@query(
    """SELECT canonical_url, array_to_string(list_sort(list_filter(['buyer_role', 'product', 'target_market'], lambda t: NOT list_contains(held, t))), ', ') AS missing,
    len(list_filter(['buyer_role', 'product', 'target_market'], lambda t: NOT list_contains(held, t))) = 0 AS complete
    FROM (SELECT canonical_url, coalesce(list(DISTINCT claim_type) FILTER (claim_type IS NOT NULL), []) AS held FROM audit GROUP BY canonical_url)"""
)
def claim_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Which types of claim each company lacks."""
    return R.coverage(table(spark, sf, "audit"), "canonical_url", "claim_type", CLAIM_TYPES)


_AGE = "coalesce(epoch_us(checked_at), -1)"


@query(
    f"""SELECT min(crawl_id) AS first_position, arg_max(crawl_id, ({_AGE}, crawl_id)) AS crawl_id, url FROM crawls WHERE url IS NOT NULL GROUP BY url
    UNION ALL SELECT NULL, crawl_id, NULL FROM crawls WHERE url IS NULL"""
)
def recrawl_newest_wins(spark: SparkSession, sf: str) -> DataFrame:
    """The newest fetch of each url at the place of its first; fetches without url are all kept, last."""
    age = F.coalesce(F.unix_micros(F.col("checked_at").cast("timestamp")), F.lit(-1)).alias("age")
    return R.newest_wins(table(spark, sf, "crawls").select("crawl_id", "url", age), "url", "crawl_id", ["age", "crawl_id"]).select("first_position", "crawl_id", "url")


@query(
    """SELECT record_id, domain, coalesce(verification_status = 'accepted' AND record_id = min(CASE WHEN verification_status = 'accepted' THEN record_id END) OVER (PARTITION BY domain), false) AS once FROM records"""
)
def accept_once(spark: SparkSession, sf: str) -> DataFrame:
    """The one accepted record that counts for each domain."""
    rows = table(spark, sf, "records").select("record_id", "domain", "verification_status")
    return R.accept_once(rows, "domain", F.coalesce(F.col("verification_status") == ACCEPTED, F.lit(False)), ["record_id"]).select("record_id", "domain", "once")


_PRIORITY = "CAST(substr(o_orderpriority, 1, 1) AS INTEGER)"


@query(f"SELECT o_orderkey, {_PRIORITY} AS priority, row_number() OVER (ORDER BY {_PRIORITY} DESC, o_orderkey) AS batch_position FROM orders ORDER BY priority DESC, o_orderkey LIMIT 100")
def next_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The next hundred queued rows by priority, then order."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"))
    return R.select_batch(rows, "priority", "o_orderkey", 100)


@query(f"SELECT {_PRIORITY} AS priority, count(*) AS queued FROM orders GROUP BY 1")
def queued_by_priority(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.substring("o_orderpriority", 1, 1).cast("int").alias("priority")).agg(F.count("*").alias("queued"))


@query("SELECT candidate_id, batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY candidate_id) AS position FROM candidates WHERE batch_id IS NOT NULL")
def batch_positions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "candidates").where("batch_id IS NOT NULL").select("candidate_id", "batch_id")
    return R.positions(rows, "batch_id", ["candidate_id"])


@query("SELECT s.verification_status, count(r.record_id) AS rows FROM (VALUES ('accepted'), ('review'), ('rejected'), ('blocked')) s(verification_status) LEFT JOIN records r USING (verification_status) GROUP BY 1")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Records by status, statuses without records included."""
    return R.counts_with_zeros(table(spark, sf, "records"), "verification_status", STATUSES)


@query(
    """SELECT count(*) AS discovered, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'batched') AS batched,
    count(*) FILTER (status = 'completed') AS completed, count(DISTINCT batch_id) AS batches FROM candidates"""
)
def progress_counts(spark: SparkSession, sf: str) -> DataFrame:
    state = lambda s: F.count_if(F.col("status") == s).alias(s)
    return table(spark, sf, "candidates").agg(F.count("*").alias("discovered"), state("queued"), state("batched"), state("completed"), F.countDistinct("batch_id").alias("batches"))


def _is_accepted() -> Column:
    return F.col("verification_status") == ACCEPTED


def _identified(spark: SparkSession, sf: str) -> DataFrame:
    """Records with the company that their JSON names: by canonical url, else by final url."""
    said = F.try_parse_json("record_json")
    rows = table(spark, sf, "records").select("record_id", "run_name", "verification_status", *[F.try_variant_get(said, f"$.{c}", "string").alias(c) for c in ("canonical_url", "final_url")])
    return rows.select("record_id", "run_name", "verification_status", record_company(F.col("canonical_url"), F.col("final_url")).alias("company"))


_IDENTIFIED = f"""j AS (SELECT record_id, CASE WHEN json_valid(record_json) THEN record_json::JSON END AS v FROM records),
    n AS (SELECT record_id, coalesce(nullif(CASE WHEN json_type(v->'canonical_url') = 'VARCHAR' THEN v->>'canonical_url' END, ''), nullif(CASE WHEN json_type(v->'final_url') = 'VARCHAR' THEN v->>'final_url' END, '')) AS raw FROM j),
    {_urls_sql("SELECT * FROM n")},
    r AS (SELECT r.record_id, run_name, verification_status, coalesce(verification_status = 'accepted', false) AS a, regexp_replace(host, '^www\\.', '') AS company FROM records r LEFT JOIN urls u ON u.record_id = r.record_id)"""


@query(f"WITH {_IDENTIFIED} SELECT record_id, company FROM r")
def record_identity(spark: SparkSession, sf: str) -> DataFrame:
    """The company of each record."""
    return _identified(spark, sf).select("record_id", "company")


@query(
    f"WITH {_IDENTIFIED} SELECT company, run_name, record_id FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY run_name NULLS FIRST, record_id) AS n FROM r WHERE a AND company IS NOT NULL) WHERE n = 1"
)
def merge_runs_accepted(spark: SparkSession, sf: str) -> DataFrame:
    """The accepted record of each company from the first run that has one; records without a run come first."""
    return R.merge_runs(_identified(spark, sf), "company", "run_name", "record_id", _is_accepted()).drop("verification_status")


@query(f"WITH {_IDENTIFIED} SELECT company, count(*) FILTER (a) AS accepted, count(*) FILTER (NOT a) AS other FROM r WHERE company IS NOT NULL GROUP BY company HAVING count(*) FILTER (a) > 0 AND count(*) FILTER (NOT a) > 0")
def merge_run_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Companies accepted in one place and not in another."""
    return R.run_conflicts(_identified(spark, sf), "company", _is_accepted())


@query(
    f"""WITH {_IDENTIFIED} SELECT run_name, count(*) FILTER (a) AS accepted, count(*) FILTER (a AND n = 1) AS merged, count(*) FILTER (a) - count(*) FILTER (a AND n = 1) AS duplicates
    FROM (SELECT run_name, a, row_number() OVER (PARTITION BY company, a ORDER BY run_name NULLS FIRST, record_id) AS n FROM r WHERE company IS NOT NULL) GROUP BY run_name"""
)
def merge_run_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.run_counts(_identified(spark, sf), "company", "run_name", "record_id", _is_accepted())


@query("SELECT evidence_text_ja, count(*) AS rows FROM audit WHERE evidence_text_ja IS NOT NULL GROUP BY 1 HAVING count(*) >= 3")
def reused_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Explanations that several claims share."""
    return R.reuse(table(spark, sf, "audit"), "evidence_text_ja", 3)


@query("SELECT flag, count(*) AS claims, count(DISTINCT canonical_url) AS companies FROM (SELECT canonical_url, unnest(flags) AS flag FROM audit) GROUP BY flag")
def audit_flag_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "audit").select("canonical_url", F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("claims"), F.countDistinct("canonical_url").alias("companies"))


@query(
    r"""SELECT audit_id, contains(q, 'Skip to') OR contains(q, 'Open Menu') OR contains(q, 'Close Menu') OR contains(q, 'Toggle menu') OR contains(q, 'Log in') OR contains(q, 'Cart')
    OR (contains(q, ' | ') AND NOT regexp_matches(q, '\$\s?\d|\d+\.\d{2}')) AS navigation,
    NOT (contains(lower(q), 'miso') OR contains(lower(q), 'matcha')) OR len(list_filter(regexp_split_to_array(lower(q), '\s+'), lambda w: w <> '')) < 3 AS thin
    FROM (SELECT audit_id, evidence_text_original AS q FROM audit WHERE evidence_text_original IS NOT NULL)"""
)
def quote_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes that look like navigation, or that are thin."""
    q = F.col("evidence_text_original")
    rows = table(spark, sf, "audit").where(q.isNotNull())
    return rows.select("audit_id", E.navigation_like(q).alias("navigation"), E.thin(q, ["miso", "matcha"], 3).alias("thin"))


_COMPANIES = """(SELECT canonical_url, max(company_type) AS kind, sum(len(coalesce(flags, []))) AS difficulty FROM audit WHERE canonical_url IS NOT NULL AND verification_status = 'accepted' GROUP BY canonical_url)"""


@query(
    f"""WITH c AS (SELECT *, coalesce(kind, '未分類') AS k, sha256(canonical_url) AS sha FROM {_COMPANIES}),
    hard AS (SELECT * FROM c WHERE difficulty > 0 ORDER BY difficulty DESC, sha LIMIT 10),
    rest AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sha) AS r FROM c WHERE canonical_url NOT IN (SELECT canonical_url FROM hard))
    SELECT canonical_url, kind, CAST(difficulty AS BIGINT) AS difficulty FROM hard UNION ALL
    SELECT canonical_url, kind, CAST(difficulty AS BIGINT) FROM (SELECT * FROM rest ORDER BY r, k LIMIT 20 - (SELECT count(*) FROM hard))"""
)
def quality_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty accepted companies: up to ten of the hardest, the rest round-robin over company types."""
    rows = table(spark, sf, "audit").where("canonical_url IS NOT NULL AND verification_status = 'accepted'")
    flags = F.size(F.coalesce("flags", F.array().cast("array<string>")))
    companies = rows.groupBy("canonical_url").agg(F.max("company_type").alias("kind"), F.sum(flags).alias("difficulty"))
    return R.quality_sample(companies, 20, "difficulty", "kind", "canonical_url")


@query("SELECT count(*) AS reviewed, count(*) FILTER (len(flags) = 0) AS correct, count(*) FILTER (len(flags) = 0) / count(*) AS precision, count(*) FILTER (len(flags) = 0) / count(*) >= 0.9 AS passed FROM audit")
def spot_check_precision(spark: SparkSession, sf: str) -> DataFrame:
    """Share of claims without a flag."""
    return R.precision(table(spark, sf, "audit"), F.size("flags") == 0, 0.9)


def _joined_sql(kind: str) -> str:
    text = "coalesce(CASE WHEN evidence_text_ja <> '' THEN evidence_text_ja END, evidence_text_original)"
    return f"coalesce(string_agg({text}, ' / ' ORDER BY audit_id) FILTER (claim_type = '{kind}' AND {text} <> ''), '') AS {kind}_text"


@query(f"SELECT canonical_url, {', '.join(map(_joined_sql, CLAIM_TYPES))} FROM audit WHERE canonical_url IS NOT NULL GROUP BY canonical_url")
def sales_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One row per company with its quotes by type of claim."""
    rows = table(spark, sf, "audit").where("canonical_url IS NOT NULL")
    return E.claim_texts(rows, "canonical_url", "audit_id").select("canonical_url", *[f"{k}_text" for k in CLAIM_TYPES])


@query(
    "SELECT canonical_url, item, arg_min(url, crawl_id) AS url, min(crawl_id) AS crawl_id FROM (SELECT canonical_url, crawl_id, coalesce(url, '') AS url, unnest(emails) AS item FROM crawls) WHERE item IS NOT NULL GROUP BY canonical_url, item"
)
def email_first_source(spark: SparkSession, sf: str) -> DataFrame:
    """Each address of a company with the page it was first seen on."""
    rows = table(spark, sf, "crawls").select("canonical_url", "crawl_id", F.coalesce("url", F.lit("")).alias("url"), "emails")
    return R.first_sources(rows, "canonical_url", "emails", "crawl_id", "url")


@query(
    """SELECT r.record_id, coalesce(l.verification_status, r.verification_status) AS verification_status FROM records r
    LEFT JOIN (SELECT regexp_extract(canonical_url, '^https?://([^/]+)', 1) AS domain, arg_max(verification_status, audit_id) AS verification_status FROM audit WHERE verification_status IS NOT NULL GROUP BY 1) l USING (domain)"""
)
def label_override(spark: SparkSession, sf: str) -> DataFrame:
    """Records with the status of the latest audit where there is one."""
    audit = table(spark, sf, "audit").where("verification_status IS NOT NULL").withColumn("domain", F.regexp_extract("canonical_url", "^https?://([^/]+)", 1))
    latest = audit.groupBy("domain").agg(F.max_by("verification_status", "audit_id").alias("verification_status"))
    return R.override(table(spark, sf, "records").select("record_id", "domain", "verification_status"), latest, "domain", "verification_status").drop("domain")


@query(
    """SELECT batch_id, coalesce(l, 0) AS left_rows, coalesce(r, 0) AS right_rows FROM (SELECT batch_id, count(*) AS l FROM candidates WHERE batch_id IS NOT NULL GROUP BY 1)
    FULL JOIN (SELECT batch_id, count(*) AS r FROM records WHERE batch_id IS NOT NULL GROUP BY 1) USING (batch_id) WHERE coalesce(l, 0) <> coalesce(r, 0)"""
)
def batch_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Batches whose candidates and records differ in number."""
    sides = [table(spark, sf, t).where("batch_id IS NOT NULL").select("batch_id") for t in ("candidates", "records")]
    return R.set_differences(*sides, ["batch_id"])


@query("SELECT c.candidate_id, r.record_id, c.batch_id, c.batch_position FROM candidates c JOIN records r ON r.batch_id = c.batch_id AND r.batch_position = c.batch_position")
def positional_join(spark: SparkSession, sf: str) -> DataFrame:
    """Records and candidates that hold the same place of a batch."""
    candidates = table(spark, sf, "candidates").select("candidate_id", "batch_id", "batch_position")
    return candidates.join(table(spark, sf, "records").select("record_id", "batch_id", "batch_position"), ["batch_id", "batch_position"]).select("candidate_id", "record_id", "batch_id", "batch_position")


@query(
    """SELECT c.candidate_id, coalesce(r.verification_status, 'review') AS verification_status FROM candidates c
    LEFT JOIN (SELECT domain, arg_max(verification_status, record_id) AS verification_status, 1 AS m FROM records WHERE domain IS NOT NULL AND verification_status IS NOT NULL GROUP BY domain) r ON r.domain = c.domain"""
)
def assessment_default(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with the status of their last record; those without one are to be reviewed."""
    records = table(spark, sf, "records").where("verification_status IS NOT NULL").select("domain", "verification_status", "record_id")
    return R.with_default(table(spark, sf, "candidates").select("candidate_id", "domain"), records, "domain", ["record_id"], {"verification_status": F.lit("review")}).drop("domain")


@query("SELECT r.verification_status AS before, a.verification_status AS after, count(*) AS rows FROM records r JOIN (SELECT canonical_url, max(verification_status) AS verification_status FROM audit WHERE verification_status IS NOT NULL GROUP BY 1) a ON a.canonical_url = 'https://' || r.domain || '/' GROUP BY 1, 2")
def status_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """How many records had one status before and another after the audit."""
    after = table(spark, sf, "audit").where("verification_status IS NOT NULL").groupBy("canonical_url").agg(F.max("verification_status").alias("after"))
    before = table(spark, sf, "records").select(F.col("verification_status").alias("before"), F.concat(F.lit("https://"), "domain", F.lit("/")).alias("canonical_url"))
    return before.join(after, "canonical_url").groupBy("before", "after").agg(F.count("*").alias("rows"))


def _links(spark: SparkSession, sf: str) -> DataFrame:
    """Each crawled page as a link of its company's home page, titled by its own title."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+([^?#]*)", 1)
    return table(spark, sf, "crawls").where("url IS NOT NULL").select(F.col("canonical_url").alias("page_id"), F.col("crawl_id").alias("link_ord"), "url", path.alias("path"), F.col("title").alias("text"), F.lit(None).cast("string").alias("kind"))


def _has_any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_LINKS = r"""SELECT canonical_url AS page_id, crawl_id AS link_ord, url, title, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) || ' ' || coalesce(title, '') AS said FROM crawls WHERE url IS NOT NULL"""
_POLICY = r"""(regexp_matches(h, '\bcookies?[\s_-]*(policy|policies|notice|settings|preferences|consent)\b') OR (regexp_matches(regexp_replace(h, '[-_/]+', ' ', 'g'), '\bcookies?\b')
    AND (regexp_matches(regexp_replace(h, '[-_/]+', ' ', 'g'), '\b(policy|policies|notice|settings|preferences|consent|richtlinien?|hinweise?|einstellungen)\b') OR lower(trim(coalesce(title, ''))) = 'how we use cookies')))"""
_GROUP = f"CASE WHEN {_has_any('h', L.NO_EVIDENCE)} OR {_POLICY} THEN NULL " + " ".join(f"WHEN {_has_any('h', words)} THEN '{name}'" for name, words in L.GROUPS.items()) + " END"
_GROUPED = f"g AS (SELECT *, {_GROUP} AS link_group FROM (SELECT *, lower(said) AS h FROM ({_LINKS})))"


@query(f"WITH {_GROUPED} SELECT link_ord, link_group FROM g")
def page_link_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _links(spark, sf).select("link_ord", L.link_group(F.col("path"), F.col("text")).alias("link_group"))


@query(
    f"""WITH {_GROUPED}, b AS (SELECT *, list_position({list(L.ORDER)}, link_group) AS rank, row_number() OVER (PARTITION BY page_id, link_group ORDER BY link_ord) AS best FROM g WHERE page_id IS NOT NULL AND list_contains({list(L.ORDER)}, link_group))
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY rank) AS INTEGER) AS position, url FROM b WHERE best = 1"""
)
def priority_links(spark: SparkSession, sf: str) -> DataFrame:
    """The best page of each group of a company, in the order of groups."""
    return L.priority_links(_links(spark, sf).where("page_id IS NOT NULL"))


@query()
def page_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Pages wrapped as HTML and parsed again: name, addresses, text and quality."""
    body = F.regexp_replace(F.regexp_replace(F.col("text"), "&", "&amp;"), "<", "&lt;")
    page = F.concat(F.lit("<html><title>"), F.coalesce("title", F.lit("")), F.lit("</title><body><p>"), F.regexp_replace(body, "\n", "</p><p>"), F.lit("</p></body></html>"))
    rows = spread(table(spark, sf, "crawls").select("crawl_id", "url", "title", "text"))
    return rows.select("crawl_id", parsed_page(page, F.col("url")).alias("p")).select("crawl_id", "p.company_name", "p.emails", "p.content_quality", F.length("p.text").alias("length"))


_SEARCHED = (
    walk_sql("SELECT 'candidates' AS t, candidate_id AS id, payload_json AS v FROM candidates")
    + f""", s AS (SELECT *, {field_sql("query")}, CAST(regexp_extract(path, '\\[(\\d+)\\]$', 1) AS BIGINT) AS page FROM found WHERE {of_list("search_runs")}),
    w AS (SELECT query, page, CASE WHEN json_type(v->'results') = 'VARCHAR' AND json_valid(v->>'results') THEN (v->>'results')::JSON ELSE v->'results' END AS a FROM s),
    x AS (SELECT * FROM w WHERE json_type(a) = 'ARRAY'), y AS (SELECT query, page, a, unnest(range(CAST(json_array_length(a) AS BIGINT))) AS n FROM x),
    z AS (SELECT query, page * 20 + n + 1 AS rank, json_extract(a, '$[' || n || ']') AS v FROM y) SELECT query, rank, v->>'url' AS url, coalesce(v->>'title', '') AS title, coalesce(v->>'description', '') AS description,
    regexp_matches({_host_sql("v->>'url'")}, '(^|[.])({"|".join(h.replace(".", "[.]") for h in DIRECTORY_HOSTS)})$') AS directory_like FROM z WHERE regexp_matches(v->>'url', '^https?://')"""
)


@query(_SEARCHED)
def search_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Results found by discovery, ranked over pages."""
    runs = child_table(table(spark, sf, "candidates"), "candidate_id", "payload_json", "search_runs", "query string, results string")
    payload = F.concat(F.lit('{"web":{"results":'), F.col("results"), F.lit("}}"))
    return ranked_results(runs.select("query", F.col("position").alias("page"), payload.alias("payload")), 20)


_TAGS = ("shop=tea", "shop=deli", "cuisine=japanese")
_TAG_HITS = "list_filter([" + ", ".join(f"CASE WHEN bool_or({'list_contains(list_transform(string_split(c, chr(59)), lambda x: trim(x)), ' + repr(v) + ')' if k == 'cuisine' else f'{k} = {v!r}'}) THEN '{k}={v}' END" for k, v in O.parse_tags(_TAGS)) + "], lambda x: x IS NOT NULL)"


@query(
    walk_sql("SELECT 'candidates' AS t, candidate_id AS id, payload_json AS v FROM candidates")
    + f""", e AS (SELECT id, path, v->>'type' AS kind, TRY_CAST(CASE WHEN json_type(v->'id') <> 'VARCHAR' THEN v->>'id' END AS BIGINT) AS nr, CASE WHEN json_type(v->'tags') = 'OBJECT' THEN v->'tags' END AS tags FROM found WHERE {of_list("osm_elements")}),
    w AS (SELECT *, {_stripped_sql("string_split(" + _stripped_sql("coalesce(nullif(tags->>'website', ''), tags->>'contact:website')") + ", ';')[1]")} AS site, tags->>'shop' AS shop, tags->>'cuisine' AS c FROM e WHERE kind IN ('node', 'way', 'relation') AND nr > 0 AND tags IS NOT NULL),
    {_urls_sql("SELECT id, path AS place, tags, shop, c, CASE WHEN contains(site, '://') THEN site ELSE 'https://' || site END AS raw FROM w WHERE site <> ''")},
    k AS (SELECT *, regexp_replace(host, '^www[.]', '') AS company, scheme || '://' || {_AUTHORITY} || '/' AS root FROM urls WHERE scheme IN ('http', 'https') AND contains(host, '.') AND NOT contains(host, ' ')
        AND NOT regexp_matches(host, '(^|[.])({"|".join(h.replace(".", "[.]") for h in SKIPPED_HOSTS)})$|[.](edu|gov|mil)$'))
    SELECT company, arg_min(root, (id, place)) AS url, arg_min(coalesce(nullif(tags->>'name', ''), tags->>'brand', ''), (id, place)) AS name, count(*) AS locations, {_TAG_HITS} AS matched_tags FROM k GROUP BY company"""
)
def osm_collapse(spark: SparkSession, sf: str) -> DataFrame:
    """Companies of the map elements in candidates, with their number of places."""
    elements = child_table(table(spark, sf, "candidates"), "candidate_id", "payload_json", "osm_elements", "type string, id bigint, tags map<string,string>").withColumn("ord", F.struct("parent_id", "path"))
    return O.collapse(elements, O.parse_tags(_TAGS)).select("company", "url", "name", "locations", "matched_tags")


_RESULTS = ("not_matched", "matched", "unclear")


@query(
    walk_sql("SELECT 'records' AS t, record_id AS id, record_json AS v FROM records")
    + f""", o AS (SELECT record_id, list_distinct(list_filter(list_transform(excluded_types, lambda w: trim(w)), lambda w: w <> '')) AS wanted FROM records JOIN campaigns ON campaign_id = run_name),
    c AS (SELECT id AS record_id, trim(v->>'type') AS type, coalesce(CASE WHEN json_type(v->'result') = 'VARCHAR' THEN v->>'result' END IN {_RESULTS}, false) AS good FROM found WHERE {of_list("exclusion_checks")} AND trim(v->>'type') <> ''),
    h AS (SELECT record_id, type, count(*) AS n, bool_and(good) AS good FROM c GROUP BY ALL), j AS (SELECT h.*, list_contains(wanted, type) AS known FROM h JOIN o USING (record_id) WHERE len(wanted) > 0)
    SELECT record_id, type, 'unknown' AS fault FROM j WHERE NOT known UNION ALL SELECT record_id, type, 'duplicate' FROM j WHERE known AND n > 1 UNION ALL SELECT record_id, type, 'invalid' FROM j WHERE known AND NOT good
    UNION ALL SELECT record_id, type, 'missing' FROM (SELECT record_id, unnest(wanted) AS type FROM o) m WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.record_id = m.record_id AND h.type = m.type)"""
)
def exclusion_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose checks of what their campaign excludes are missing, repeated, unknown or without a result."""
    checks = child_table(table(spark, sf, "records"), "record_id", "record_json", "exclusion_checks", "type string, result string").withColumnRenamed("parent_id", "record_id")
    excluded = table(spark, sf, "campaigns").select(F.col("campaign_id").alias("run_name"), F.col("excluded_types").alias("wanted"))
    owners = table(spark, sf, "records").select("record_id", "run_name").join(excluded, "run_name").select("record_id", "wanted")
    return C.required_set(checks, "record_id", "type", "result", owners, _RESULTS)


@query(
    """WITH r AS (SELECT canonical_url, evidence_text_ja AS reason FROM audit WHERE evidence_text_ja <> '' AND canonical_url IS NOT NULL), u AS (SELECT reason, count(*) AS n FROM r GROUP BY reason)
    SELECT canonical_url, min(n) AS least_used FROM r JOIN u USING (reason) GROUP BY canonical_url HAVING min(n) >= 2"""
)
def boilerplate_companies(spark: SparkSession, sf: str) -> DataFrame:
    """Companies all of whose explanations are used for other claims too."""
    return C.all_reused(table(spark, sf, "audit").where("canonical_url IS NOT NULL"), "canonical_url", "evidence_text_ja", 2)


@query(
    r"""SELECT crawl_id, regexp_matches(text, '(?i)\bfranchis(?:e|ing|ee)\b|\bown a (?:franchise|location|store)\b') AS franchise,
    regexp_matches(text, '(?i)permanently closed|we have closed|has closed its doors|closed for good|(?:café|cafe|shop|store) has closed|opening soon|now hiring for our opening') AS closure FROM crawls WHERE text IS NOT NULL"""
)
def page_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that speak of a franchise or a closure."""
    return table(spark, sf, "crawls").where("text IS NOT NULL").select("crawl_id", *C.page_signals(F.col("text")))


@query()
def crawl_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Bounded crawls over the stored pages; each company's home page links to its pages of each group of links."""
    crawls = table(spark, sf, "crawls").where("url IS NOT NULL AND canonical_url IS NOT NULL").withColumn("who", url_identity(F.col("url"))).withColumn("key", F.col("who.canonical")).where("key IS NOT NULL")
    newest = crawls.groupBy("key").agg(F.max_by(F.struct("url", "status_code"), "crawl_id").alias("p"))
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+([^?#]*)", 1)
    links = crawls.withColumn("kind", L.link_group(path, F.lit(""))).where("kind IS NOT NULL").withColumn("rank", -L.link_score(F.col("kind"), path, F.lit("")))
    links = links.groupBy("canonical_url", "kind", "key").agg(F.min(F.struct("rank", "url", "who")).alias("best"))
    homes = crawls.select("canonical_url").distinct().withColumn("home", url_identity(F.col("canonical_url"))).withColumn("key", F.col("home.canonical")).where("key IS NOT NULL")
    links = links.join(homes.select("canonical_url", "home"), "canonical_url").where(same_site_columns(F.col("home"), F.col("best.who")))
    # replay passes over pages it has seen, two an attempt at most, so that the best of a group is always among eleven.
    links = links.withColumn("place", F.row_number().over(Window.partitionBy("canonical_url", "kind").orderBy("best.rank", "best.url"))).where("place <= 11")
    link = F.concat(F.lit('<a href="'), "best.url", F.lit('">page</a>'))
    nav = links.groupBy("canonical_url").agg(F.array_join(F.sort_array(F.collect_list(link)), "").alias("nav"))  # eleven links a group at most
    homes = homes.join(nav, "canonical_url", "left")
    pages = newest.join(homes.select("key", "nav").dropDuplicates(["key"]), "key", "left")
    pages = pages.select(F.col("key").alias("url"), F.col("p.url").alias("final_url"), F.col("p.status_code").alias("status"), F.coalesce("nav", F.lit("")).alias("html"))
    return replay(homes.select(F.col("canonical_url").alias("company"), F.col("canonical_url").alias("url")), pages).drop("contacts")


@query("SELECT DISTINCT campaign_id, trim(k) AS keyword FROM (SELECT campaign_id, unnest(product.keywords) AS k FROM campaigns) WHERE trim(k) <> ''")
def campaign_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return P.keywords(table(spark, sf, "campaigns"))


@query(
    """SELECT campaign_id, CASE WHEN coalesce(contains(lower(objective), 'hospitality'), false) OR len(list_filter(['cafe', 'café', 'coffee shop', 'restaurant', 'カフェ', 'レストラン'], lambda w: contains(words, w))) > 0
    THEN ['about', 'menu', 'locations', 'contact'] ELSE ['about', 'products', 'distribution', 'locations', 'contact'] END AS groups
    FROM (SELECT campaign_id, objective, coalesce(lower(array_to_string(flatten(list_transform(buyer_types, lambda b: list_concat([b.name], coalesce(b.keywords, [])))), ' ')), '') AS words FROM campaigns)"""
)
def campaign_link_order(spark: SparkSession, sf: str) -> DataFrame:
    """Which groups of links each campaign reads first."""
    return P.link_order(table(spark, sf, "campaigns"))


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS rows FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def stream_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Events per day and type, counted as a stream."""
    rows = table(spark, sf, "events").select("ts", "event_type")
    stream = spark.readStream.schema(rows.schema).parquet(f"{sf}/events.parque[t]").where("ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    store = NewestRows(spark, f"{folder}/table", ["window", "event_type"], ["rows"])
    keep_counts(arrivals(stream, "ts", "1 day", "1 day", "event_type"), store, f"{folder}/progress").awaitTermination()
    return store.current().select(F.col("window.start").cast("date").alias("day"), "event_type", "rows")


@query(
    f"""WITH k AS (SELECT campaign_id AS run_name, array_to_string(list_transform(list_filter(coalesce(market.keywords, []), lambda w: w <> ''), lambda w: regexp_replace(w, '([^\\p{{L}}\\p{{N}}_\\s])', '\\\\\\1', 'g')), '|') AS words FROM campaigns),
    p AS (SELECT crawl_id, run_name, text FROM crawls WHERE {_USABLE})
    SELECT crawl_id, {", ".join(f"regexp_matches(text, $${'|'.join(E.MARKETS[r])}$$ || CASE WHEN words = '' THEN '' ELSE '|' || words END) AS {r}" for r in E.MARKETS)} FROM p JOIN k USING (run_name)"""
)
def market_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a usable page names its campaign's market, in the three readings; campaigns are a configuration table of a dozen rows.

    The SQL twin's word boundaries know only ASCII, so a name that touches a letter beyond it (four of 17,417 pages at scale 0.1) counts there and not here.
    """
    words = table(spark, sf, "campaigns").select(F.col("campaign_id").alias("run_name"), *[E.market_column(F.col("market.keywords"), r).alias(r) for r in E.MARKETS])
    pages = table(spark, sf, "crawls").where(_usable()).select("crawl_id", "run_name", "text")
    return pages.join(words, "run_name").select("crawl_id", *[F.rlike("text", F.col(r)).alias(r) for r in E.MARKETS])


@query(
    """SELECT canonical_url, url, 'form_found' AS verification, row_number() OVER (PARTITION BY canonical_url ORDER BY met, url) AS position
    FROM (SELECT canonical_url, url, min(crawl_id) AS met FROM crawls WHERE status_code BETWEEN 200 AND 299 AND lower(trim(content_quality)) = 'readable' AND has_form AND url IS NOT NULL GROUP BY 1, 2)"""
)
def contact_forms(spark: SparkSession, sf: str) -> DataFrame:
    """The contact forms of each company, in the order its pages were read."""
    return R.contact_forms(table(spark, sf, "crawls").select("canonical_url", "crawl_id", "url", "has_form", "status_code", "content_quality"), None, "canonical_url", "crawl_id")


@query(
    f"""WITH k AS (SELECT campaign_id AS run_name, list_filter(list_transform(product.keywords, lambda w: lower(trim(w))), lambda w: w <> '') AS words FROM campaigns),
    c AS (SELECT run_name, canonical_url, bool_or(coalesce({_USABLE}, false)) AS read, bool_or(coalesce({_USABLE}, false) AND len(list_filter(words, lambda w: contains(lower(text), w))) > 0) AS hit FROM crawls JOIN k USING (run_name) WHERE canonical_url IS NOT NULL GROUP BY ALL)
    SELECT run_name, count(*) AS crawled, count(*) FILTER (NOT read) AS without_page, count(*) FILTER (read AND NOT hit) AS without_product, count(*) FILTER (hit) AS to_assess FROM c GROUP BY run_name"""
)
def prescreen_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Of each campaign's companies, how many have no usable page, none that names the product, and how many are left to assess."""
    words = P.keywords(table(spark, sf, "campaigns")).groupBy("campaign_id").agg(F.collect_list(F.lower("keyword")).alias("words")).withColumnRenamed("campaign_id", "run_name")
    runs = table(spark, sf, "campaigns").select(F.col("campaign_id").alias("run_name")).join(words, "run_name", "left")
    pages = table(spark, sf, "crawls").where("canonical_url IS NOT NULL").select("run_name", "canonical_url", F.coalesce(_usable(), F.lit(False)).alias("read"), F.lower("text").alias("low"))
    hit = F.col("read") & F.coalesce(F.exists("words", lambda w: F.contains(F.col("low"), w)), F.lit(False))
    companies = pages.join(runs, "run_name").groupBy("run_name", "canonical_url").agg(F.max("read").alias("read"), F.max(hit).alias("hit"))
    return companies.groupBy("run_name").agg(F.count("*").alias("crawled"), F.count_if(~F.col("read")).alias("without_page"), F.count_if(F.col("read") & ~F.col("hit")).alias("without_product"), F.count_if("hit").alias("to_assess"))


@query(
    walk_sql("SELECT 'candidates' AS t, candidate_id AS id, payload_json AS v FROM candidates")
    + f"""SELECT count(DISTINCT {field_sql("query").removesuffix(" AS query")}) AS queries, count(*) AS runs, CAST(sum(coalesce(CASE WHEN json_type(v->'results') = 'ARRAY' THEN json_array_length(v->'results') END, 0)) AS BIGINT) AS results FROM found WHERE {of_list("search_runs")}"""
)
def search_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Queries, runs and results of discovery."""
    runs = child_table(table(spark, sf, "candidates"), "candidate_id", "payload_json", "search_runs", "query string, results array<string>")
    return runs.agg(F.countDistinct("query").alias("queries"), F.count("*").alias("runs"), F.sum(F.coalesce(F.size("results"), F.lit(0))).cast("bigint").alias("results"))


@query(
    """SELECT campaign_id, fault FROM (SELECT campaign_id, unnest(list_filter([CASE WHEN coalesce(trim(product.name) = '', true) THEN 'product.name' END, CASE WHEN coalesce(len(product.keywords) < 1, true) THEN 'product.keywords' END,
    CASE WHEN coalesce(trim(market.name) = '', true) THEN 'market.name' END, CASE WHEN coalesce(len(market.keywords) < 1, true) THEN 'market.keywords' END, CASE WHEN coalesce(len(buyer_types) < 1, true) THEN 'buyer_types' END,
    CASE WHEN NOT coalesce(product_evidence.rule IN ('already_handles', 'can_use'), false) THEN 'product_evidence.rule' END, CASE WHEN coalesce(trim(product_evidence.summary_ja) = '', true) THEN 'product_evidence.summary_ja' END,
    CASE WHEN coalesce(research_mode, 'standard') NOT IN ('standard', 'batch') THEN 'research_mode' END,
    CASE WHEN NOT coalesce(target_accepted, 50) BETWEEN 1 AND (CASE WHEN research_mode = 'batch' THEN 1000 ELSE 50 END) THEN 'target_accepted' END,
    CASE WHEN NOT coalesce(max_candidates, 100) BETWEEN 1 AND (CASE WHEN research_mode = 'batch' THEN 5000 ELSE 100 END) OR coalesce(max_candidates, 100) < coalesce(target_accepted, 50) THEN 'max_candidates' END,
    CASE WHEN NOT coalesce(max_pages_per_company, 5) BETWEEN 1 AND 5 THEN 'max_pages_per_company' END, CASE WHEN coalesce(research_mode, 'standard') = 'batch' AND NOT coalesce(batch_size, 50) BETWEEN 1 AND 100 THEN 'batch_size' END],
    lambda x: x IS NOT NULL)) AS fault FROM campaigns)"""
)
def campaign_faults(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with the form of each campaign."""
    return P.faults(table(spark, sf, "campaigns"))


@query(r"""SELECT candidate_id, regexp_matches(url, '^(?i)[\s]*https?://') AS web FROM candidates WHERE url IS NOT NULL AND regexp_matches(url, '^[a-z]+://[a-z0-9.-]+(/[a-z0-9/._-]*)?$')""")
def fetch_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a plainly written address may be fetched as far as its scheme and port say."""
    refused = F.pandas_udf(lambda urls: urls.map(refused_target), "string").asNondeterministic()
    rows = table(spark, sf, "candidates").where(F.col("url").rlike("^[a-z]+://[a-z0-9.-]+(/[a-z0-9/._-]*)?$"))
    return rows.select("candidate_id", refused("url").isNull().alias("web"))


@query("SELECT url, final_url, status, fetched_with FROM (SELECT a.url, coalesce(b.url, a.url) AS final_url, coalesce(b.status, a.status) AS status, CASE WHEN b.url IS NULL THEN 'plain' ELSE 'rendered' END AS fetched_with FROM "
       "(SELECT url, arg_min(status_code, crawl_id) AS status, arg_min(coalesce(length(trim(text)), 0), crawl_id) AS n, arg_min(coalesce(contains(lower(text), 'enable javascript') OR contains(lower(text), 'javascript is required'), false), crawl_id) AS asks, "
       "arg_min(coalesce(length(text) - length(replace(text, chr(65533), '')) > greatest(3, length(text) // 50), false), crawl_id) AS bad FROM (SELECT * REPLACE (coalesce(status_code, -1) AS status_code) FROM crawls) WHERE url IS NOT NULL AND coalesce(fetched_with, '') <> 'browser' GROUP BY url) a "
       "LEFT JOIN (SELECT url, arg_min(status_code, crawl_id) AS status FROM (SELECT * REPLACE (coalesce(status_code, -1) AS status_code) FROM crawls) WHERE url IS NOT NULL AND fetched_with = 'browser' GROUP BY url) b ON a.url = b.url AND a.status NOT IN (401, 403, 429) AND (a.status < 0 OR a.status >= 400 OR n < 200 OR asks OR bad))")
def fetch_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Which of a url's first plain and first rendered fetch is used; -1 stands for no answer."""
    rows = table(spark, sf, "crawls").where("url IS NOT NULL").withColumn("status_code", F.coalesce("status_code", F.lit(-1)))
    first = F.min_by(F.struct("status_code", F.coalesce(F.trim("text"), F.lit("")).alias("text")), "crawl_id").alias("p")
    shown = lambda df: df.groupBy("url").agg(first).select("url", F.col("url").alias("final_url"), F.col("p.status_code").alias("status"), F.lit("").alias("html"), F.col("p.text").alias("text"), F.col("p.text").alias("visible_text"))
    browser = F.coalesce(F.col("fetched_with") == "browser", F.lit(False))
    return choose_fetch(shown(rows.where(~browser)), shown(rows.where(browser))).select("url", "final_url", "status", "fetched_with")
