"""Deduplicating new batches against all history by sorted-neighbourhood runs.

Every row has one sort key: its host with the labels reversed, or its tenant on a shared
host. In key order a host is followed at once by the hosts below it, so a company is a
window of neighbours that starts at its shortest host. A batch is reduced to its distinct
keys with their first ids, sorted and written as a run beside the earlier ones, and compared
only with the windows of earlier keys around its own.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce
from posixpath import normpath
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.session import cut_lineage, shared_dir
from gneiss.sources.sinks import Pointer

_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*:(?=//)")
_NO_HOST = re.compile(r"(?:mailto|tel|javascript|data|about|urn):", re.I)
_AUTHORITY_END = re.compile(r"[/?#\\]")
_HYPHENS = re.compile("[-\u00ad֊‐-―−⸺⸻﹘﹣－]")
_DOTS = re.compile("[。．｡]")
_BAD_HOST = re.compile(r"[\s\x00-\x20/\\@:\[\]<>\"]")
_TRIM = "".join(map(chr, range(33))) + "\x7f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200E))) + "\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"


def split_address(address: str) -> tuple[str, str] | None:
    """Host in its one form and raw path of an address, or None without a usable host.

    Scheme, user, port, query, case, widths, hyphens, a dot at the end and a leading "www."
    fall away. A host has a dot; a port that is no number makes it unusable.
    """
    s = address.strip(_TRIM)
    if _NO_HOST.match(s):
        return None
    if m := _SCHEME.match(s):
        s = s[m.end() :]
    s = s.lstrip("/\\") if s[:2] in ("//", "\\\\") else s
    m = _AUTHORITY_END.search(s)
    authority, rest = (s[: m.start()], s[m.start() :]) if m else (s, "")
    host, colon, port = authority.rpartition("@")[2].partition(":")
    port = unicodedata.normalize("NFKC", port).strip()
    if port and not (port.isascii() and port.isdigit()):
        return None
    host = unicodedata.normalize("NFKC", _DOTS.sub(".", host)).lower()
    host = _HYPHENS.sub("", host).rstrip(".")
    if host.startswith("www.") and "." in host[4:]:
        host = host[4:]
    if "." not in host or _BAD_HOST.search(host) or "" in host.split("."):
        return None
    return host, re.split(r"[?#]", rest, maxsplit=1)[0]


def tenant_of(path: str, prefix: str) -> str:
    """The tenant that a path names on a shared host, "" for none.

    The path is decoded until nothing changes and resolved. ``prefix`` says what stands before
    the tenant's name: "" nothing, "~" that mark within the first segment, else whole segments.
    """
    path = re.sub(r";[^/]*$", "", path)
    while (decoded := unquote(path)) != path:
        path = decoded
    path = normpath("/" + path.replace("\\", "/").lstrip("/"))
    parts = [p for p in path.split("/") if p]
    lead = [p for p in prefix.split("/") if p] if prefix.endswith("/") else []
    if parts[: len(lead)] != lead:
        return ""
    parts = parts[len(lead) :]
    mark = "" if prefix.endswith("/") else prefix
    if not parts or not parts[0].startswith(mark):
        return ""
    return parts[0][len(mark) :]


def company_key(address: str | None, tenants: dict[str, str]) -> str | None:
    """Sort key of the company that an address names: labels from the right, parted by spaces.

    On a host of ``tenants`` the key is "/host/tenant"; without a tenant the address names none.
    """
    found = split_address(address) if address else None
    if not found:
        return None
    host, path = found
    if host in tenants:
        tenant = tenant_of(path, tenants[host])
        return f"/{host}/{tenant}" if tenant else None
    return " ".join(reversed(host.split(".")))


#: Shared hosts up to which a copy goes to every task; larger tables are joined.
HELD_HOSTS = 10_000


def shared_tenants(shared_hosts: DataFrame, most: int = HELD_HOSTS) -> dict[str, str] | None:
    """Host to tenant prefix, None for more than ``most`` rows."""
    rows = shared_hosts.select("host", "tenant_prefix").limit(most + 1).collect()
    if len(rows) > most:
        return None
    parsed = sorted((p[0], r.tenant_prefix or "") for r in rows if (p := split_address(r.host or "")))
    return dict(parsed)


def key_column(tenants: dict[str, str], url: Column, domain: Column) -> Column:
    """Key of a row: the url decides; if it names no company, the domain does; else null."""

    @F.pandas_udf("string")
    def keys(urls: pd.Series, domains: pd.Series) -> pd.Series:
        return pd.Series([company_key(u, tenants) or company_key(d, tenants) for u, d in zip(urls, domains)], dtype=object)

    return keys.asNondeterministic()(url, domain)  # so that a filter on the key does not compute it again


def _joined_keys(rows: DataFrame, shared_hosts: DataFrame) -> DataFrame:
    """``rows`` with ``key`` from ``_url`` and ``_domain``, where the shared hosts are too many to be held: two joins on the host."""

    @F.pandas_udf("struct<host:string,path:string>")
    def split(addresses: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(split_address(a) if a else None) or (None, None) for a in addresses], columns=["host", "path"])

    @F.pandas_udf("string")
    def key(hosts: pd.Series, paths: pd.Series, prefixes: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else company_key(h + (p or ""), {} if x is None else {h: x}) for h, p, x in zip(hosts, paths, prefixes)], dtype=object)

    shared = shared_hosts.select(split.asNondeterministic()("host")["host"].alias("_host"), F.coalesce("tenant_prefix", F.lit("")).alias("_prefix")).where("_host IS NOT NULL").groupBy("_host").agg(F.max("_prefix").alias("_prefix"))
    for name in ("_url", "_domain"):
        parted = rows.withColumn("_at", split.asNondeterministic()(name)).withColumn("_host", F.col("_at.host"))
        rows = parted.join(shared, "_host", "left").withColumn(name, key.asNondeterministic()("_host", "_at.path", "_prefix")).drop("_at", "_host", "_prefix")
    return rows.withColumn("key", F.coalesce("_url", "_domain"))


def keyed_rows(df: DataFrame, shared_hosts: DataFrame, id_col: str, url_col: str, domain_col: str, batch: Column | None = None, most: int = HELD_HOSTS) -> DataFrame:
    """``id, key`` (and ``batch``) of the rows that name a company."""
    named = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("_url"), F.col(domain_col).alias("_domain"), *([] if batch is None else [batch.alias("batch")])).where("id IS NOT NULL")
    tenants = shared_tenants(shared_hosts, most)
    keyed = _joined_keys(named, shared_hosts) if tenants is None else named.withColumn("key", key_column(tenants, F.col("_url"), F.col("_domain")))
    return keyed.drop("_url", "_domain").where("key IS NOT NULL")


def chain(key: Column) -> Column:
    """A key and all keys above it, the shortest first; a tenant stands by itself."""
    labels = F.split(key, " ")
    return F.when(key.startswith("/"), F.array(key)).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, 1, n), " ")))


def windows_by_batch(firsts: DataFrame, before: DataFrame | None) -> DataFrame:
    """``key, batch, first_id`` (of the key's whole company as it stood once that batch was in).

    ``firsts`` has the distinct keys of each batch with their first ids, ``before`` those of all earlier
    batches. The running minimum takes one row for each batch of ``firsts`` and key of a company.
    """
    rows = firsts.select("key", "batch", "first_id")
    if before is not None:
        rows = rows.unionByName(before.select("key", F.lit(None).cast(firsts.schema["batch"].dataType).alias("batch"), "first_id"))
    links = rows.withColumn("top", F.explode(chain(F.col("key")))).join(rows.select(F.col("key").alias("top")).distinct(), "top", "left_semi")
    so_far = Window.partitionBy("top").orderBy(F.asc_nulls_first("batch")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tops = links.groupBy("top", "batch").agg(F.min("first_id").alias("first_id"), F.max(F.col("key") == F.col("top")).alias("here"))
    tops = tops.select("top", "batch", F.min("first_id").over(so_far).alias("first_id"), F.max("here").over(so_far).alias("here")).where("here")
    heads = links.where("batch IS NOT NULL").select("key", "batch", "top").join(tops, ["top", "batch"])
    return heads.groupBy("key", "batch").agg(F.min_by("first_id", F.length("top")).alias("first_id"))


#: Keys in one file of a run.
RANGE_KEYS = 1_000_000


class History:
    """Persisted sorted runs of keys with their first ids, in a folder that all executors share.

    A run is range-partitioned and sorted by key; the manifest names the runs, their files and the first and last
    key of each file, and is replaced at once, so a lost driver leaves the state before or after a batch. Run
    names are never used twice. ``admit`` writes one sorted run for its batch and reads of history only the files
    whose key range holds a key above a new one, or meets the window of a company that a new key belongs to.
    ``fan`` runs of one tier are merged into one of the next, after which their folders are removed, so a key is
    written once a tier. The manifest has a line for every RANGE_KEYS keys and is what the driver holds.
    A batch admitted twice gives the same rows: the smallest id of a key wins.
    """

    def __init__(self, spark, folder: str, fan: int = 8, range_keys: int = RANGE_KEYS):
        self.spark, self.folder, self.fan, self.range_keys = spark, folder.rstrip("/"), fan, range_keys
        self.pointer = Pointer(spark, self.folder, "MANIFEST")
        told = self.pointer.read()
        state = json.loads(told) if told else {"kind": "bigint", "runs": []}
        self.kind: str = state["kind"]
        #: each run: name, tier and files [path, first key, last key, keys], in key order
        self.runs: list[dict] = state["runs"]

    def _publish(self, runs: list[dict]) -> None:
        self.pointer.publish(json.dumps({"kind": self.kind, "runs": runs}))
        self.runs = runs

    def _write(self, firsts: DataFrame, keys: int, tier: int) -> dict:
        """Writes one run; it counts once the manifest names it."""
        path = f"{self.folder}/run-{uuid.uuid4().hex}"
        firsts.select("key", "first_id").repartitionByRange(max(1, -(-keys // self.range_keys)), "key").sortWithinPartitions("key").write.parquet(path)
        ranges = self.spark.read.schema(self.schema).parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("keys"))
        return {"path": path, "tier": tier, "files": [list(r) for r in ranges.orderBy("low").collect()]}

    @property
    def schema(self) -> str:
        return f"key string, first_id {self.kind}"

    def read(self, files: list[str] | None = None) -> DataFrame:
        """Keys with their first ids in some files, or in all; a key may stand in several runs."""
        files = [f[0] for run in self.runs for f in run["files"]] if files is None else files
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def files(self, spans: DataFrame) -> list[str]:
        """Files of all runs whose range meets one of the spans ``low, high``. Each task finds them by bisection and gives each once."""
        runs = [([f[1] for f in run["files"]], [f[2] for f in run["files"]], [f[0] for f in run["files"]]) for run in self.runs]

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: set[str] = set()
            for batch in batches:
                for low, high in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for lows, highs, names in runs:
                        found.update(names[bisect_left(highs, low) : bisect_right(lows, high)])
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["file"])

        return [r[0] for r in spans.select("low", "high").mapInArrow(meet, "file string").distinct().collect()]  # at most all files

    def around(self, keys: DataFrame, new: bool = True) -> DataFrame:
        """``root, key, first_id`` of the keys of history in the windows around ``keys``; the roots of ``keys`` are found among both.

        With ``new`` false ``keys`` are of history themselves and are no roots of their own accord.
        """
        links = keys.select(F.col("key").alias("of"), F.explode(chain(F.col("key"))).alias("top"))
        points = links.select("top").distinct()
        held = self.read(self.files(points.select(F.col("top").alias("low"), F.col("top").alias("high")))).select(F.col("key").alias("top")).join(points, "top", "left_semi")
        present = (held.union(keys.select("key")) if new else held).distinct()
        roots = cut_lineage(links.join(present, "top").groupBy("of").agg(F.min_by("top", F.length("top")).alias("root")).select("root").distinct())
        window = roots.select(F.col("root").alias("low"), F.when(F.col("root").startswith("/"), F.col("root")).otherwise(F.concat("root", F.lit("!"))).alias("high"))  # "!" follows the space between labels
        inside = self.read(self.files(window)).withColumn("root", F.explode(chain(F.col("key")))).join(roots, "root", "left_semi")
        return inside.groupBy("root", "key").agg(F.min("first_id").alias("first_id"))

    def admit(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Takes a batch of ``id, key`` rows in; gives ``id, key, first_id`` of all of them and the ``key`` values whose company changed.

        With a column ``batch`` (ordered, not null) the rows are several batches admitted in one go: each row meets
        its own batch and those before it, as if they came one by one. A key has changed if the batch brought a
        smaller id or a host above the company it had been of; ``settle`` gives its rows their first id anew.
        """
        rows = cut_lineage(rows if "batch" in rows.columns else rows.withColumn("batch", F.lit(0)))
        by_batch = rows.groupBy("key", "batch").agg(F.min("id").alias("first_id"))
        self.kind = rows.schema["id"].dataType.simpleString()
        run = self._write(by_batch.groupBy("key").agg(F.min("first_id").alias("first_id")), rows.count(), 0)
        mine = self.read([f[0] for f in run["files"]])
        before = cut_lineage(self.around(mine)) if self.runs and run["files"] else None
        arrived = windows_by_batch(by_batch, before)
        everything = mine.select("key", "first_id") if before is None else mine.select("key", "first_id").unionByName(before.select("key", "first_id")).groupBy("key").agg(F.min("first_id").alias("first_id"))
        now = windows_by_batch(everything.withColumn("batch", F.lit(0)), None).select("key", F.col("first_id").alias("now"))
        changed = arrived.join(now, "key").where("first_id <> now").select("key")
        if before is not None:
            was = before.groupBy("root").agg(F.min("first_id").alias("was"), F.max(F.col("key") == F.col("root")).alias("had"))
            changed = changed.union(before.join(was, "root").join(now, "key").where("was <> now OR NOT had").select("key"))
        found = rows.join(arrived, ["key", "batch"]).select("id", "key", "first_id", F.lit(True).alias("row"))
        both = cut_lineage(found.unionByName(changed.distinct().select(F.lit(None).cast(self.kind).alias("id"), "key", F.lit(None).cast(self.kind).alias("first_id"), F.lit(False).alias("row"))))
        if run["files"]:
            self._publish([*self.runs, run])
            self._compact()
        return both.where("row").drop("row"), both.where("NOT row").select("key")

    def _compact(self) -> None:
        """Merges the runs of each full tier; old folders go once the manifest no longer names them."""
        tier = 0
        while len(full := [r for r in self.runs if r["tier"] == tier]) >= self.fan:
            keys = sum(f[3] for r in full for f in r["files"])
            merged = self.read([f[0] for r in full for f in r["files"]]).groupBy("key").agg(F.min("first_id").alias("first_id"))
            run = self._write(merged, keys, tier + 1)
            self._publish([r for r in self.runs if r["tier"] != tier] + [run])
            for r in full:
                self.pointer.remove(r["path"])
            tier += 1

    def settle(self, rows: DataFrame, changed: DataFrame) -> DataFrame:
        """``first_id, id`` of the admitted rows whose company has a smaller id by now; only rows of changed keys are looked up again."""
        keys = cut_lineage(changed.distinct())
        windows = self.around(keys, new=False)
        firsts = windows.groupBy("root").agg(F.min("first_id").alias("now"))
        now = windows.join(firsts, "root").select("key", "now")
        return rows.join(now, "key", "left").select(F.coalesce("now", "first_id").alias("first_id"), "id").where("id > first_id")

    def drop(self) -> None:
        """Removes the folder."""
        self.pointer.remove(self.folder)


#: Rows that are admitted in one go where many batches arrive at once: an admission costs some seconds whatever its size.
ROWS_AT_ONCE = 50_000


def duplicates(
    df: DataFrame, shared_hosts: DataFrame, id_col: str = "candidate_id", url_col: str = "url", domain_col: str = "domain", batch: Column | None = None, at_once: int = ROWS_AT_ONCE, history: History | None = None, settled: bool = True
) -> DataFrame:
    """``first_id`` and ``id_col`` of each row whose company has a row with a smaller id.

    Rows are admitted to ``history`` (a new one, removed at the end, if none is given) batch by batch, as many
    consecutive values of ``batch`` in one go as hold ``at_once`` rows with the last of them; rows without a batch come
    first, and without ``batch`` all rows are one batch. The rows don't depend on ``at_once``. ``settled`` gives first ids as they are after the last batch,
    else as they were at each row's own.

    Rows without a usable url and domain, and rows without id, are no case; rows repeated with one id are not
    later than themselves; ties don't arise as ids order the rows. Empty tables give no row. Only the named
    columns are read, so extra columns and their names don't matter.
    """
    spark = df.sparkSession
    own = history or History(spark, f"{shared_dir(spark)}/history-{uuid.uuid4().hex}")
    order = F.lit(0) if batch is None else F.coalesce(batch.cast("long"), F.lit(-(2**63)))
    rows = cut_lineage(keyed_rows(df, shared_hosts, id_col, url_col, domain_col, order))
    sizes = rows.groupBy("batch").count().orderBy("batch").collect()  # one row a batch
    admitted, low, held = [], None, 0
    for n, (number, size) in enumerate(sizes):
        low, held = number if low is None else low, held + size
        if held >= at_once or n + 1 == len(sizes):
            admitted.append(own.admit(rows.where(F.col("batch").between(low, number))))
            low, held = None, 0
    if not admitted:
        return rows.select(F.col("id").alias("first_id"), F.col("id").alias(id_col)).limit(0)
    found = reduce(DataFrame.unionByName, [a for a, _ in admitted])
    if settled:
        found = cut_lineage(own.settle(found, reduce(DataFrame.unionByName, [c for _, c in admitted])))
    if history is None:
        own.drop()
    return found.where("id > first_id").select("first_id", F.col("id").alias(id_col))
