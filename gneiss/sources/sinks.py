"""Writers: JSON that keeps nulls, partitioned parts, report CSV, and snapshots that appear at once."""

from __future__ import annotations

import csv
import io
import json
import os
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.session import cut_lineage
from gneiss.sources.json_arrays import csv_rows


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, explicit nulls kept."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_parts(df: DataFrame, path: str, part: str) -> None:
    """One folder per part; rows of a part are brought together first, so each folder gets few files."""
    df.repartition(part).write.mode("overwrite").partitionBy(part).json(path, ignoreNullFields=False)


def report_chunks(rows: Iterable, columns: list[str]) -> Iterator[bytes]:
    """Lines of a report: byte-order mark, CRLF, quotes doubled where needed, null as empty."""
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator="\r\n")
    yield b"\xef\xbb\xbf"
    for row in chain((columns,), rows):
        writer.writerow(["" if v is None else v for v in row])
        yield out.getvalue().encode("utf-8")
        out.seek(0)
        out.truncate()


def report_csv(rows: Iterable, columns: list[str]) -> bytes:
    return b"".join(report_chunks(rows, columns))


def write_report(df: DataFrame, path: str) -> int:
    """A report for people in one file, streamed partition by partition through the driver, which holds one partition at a time; gives its rows."""
    n = 0

    def counted() -> Iterator:
        nonlocal n
        for row in df.toLocalIterator():
            n += 1
            yield row

    with open(path, "wb") as f:
        for chunk in report_chunks(counted(), df.columns):
            f.write(chunk)
    return n


def write_labelled_report(df: DataFrame, path: str, key: str, labels: tuple[str, ...]) -> int:
    """A report that keeps what people wrote into an earlier one at ``path``: the columns ``labels``, found again by ``key``.

    Rows new to the report have empty labels; of rows repeated in the earlier report the last one counts. The new
    file takes the place of the old one once it is whole.
    """
    kept = df.select(*[c for c in df.columns if c not in labels])
    if os.path.exists(path):
        spark = df.sparkSession
        old = csv_rows(spark, path, key).withColumn("_n", F.monotonically_increasing_id())
        old = old.select(key, "_n", *[F.coalesce(F.col(c), F.lit("")).alias(c) if c in old.columns else F.lit("").alias(c) for c in labels])
        old = old.groupBy(key).agg(*[F.max_by(c, "_n").alias(c) for c in labels])
        kept = kept.join(old, key, "left")
        made = kept.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in labels else F.col(c) for c in [*[c for c in df.columns if c not in labels], *labels]])
    else:
        made = kept.select("*", *[F.lit("").alias(c) for c in labels])
    n = write_report(made, f"{path}.new")
    os.replace(f"{path}.new", path)
    return n


class Parts:
    """A table that only grows, as a list of parts behind a pointer: adding writes the new rows and nothing else."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._pointer = Pointer(spark, folder)

    def current(self) -> DataFrame | None:
        parts = (self._pointer.read() or "").split()
        return self.spark.read.parquet(*[f"{self.folder}/{p}" for p in parts]) if parts else None

    def add(self, df: DataFrame) -> None:
        """A failure before the pointer is renamed leaves the table as it was."""
        part = f"p-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{part}")
        self._pointer.publish(" ".join([*(self._pointer.read() or "").split(), part]))


class NewestRows:
    """The newest row per key, in ``buckets`` by the key's hash: a merge rewrites the buckets of its keys and leaves the others alone."""

    def __init__(self, spark: SparkSession, folder: str, key: list[str], age: list[str], buckets: int = 64):
        self.spark, self.folder, self.key, self.age, self.buckets = spark, folder.rstrip("/"), key, age, buckets
        self._pointer = Pointer(spark, folder)

    def _state(self) -> dict[str, str]:
        return json.loads(self._pointer.read() or "{}")

    def _read(self, versions: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.folder}/{v}" for v in versions]) if versions else None

    def current(self) -> DataFrame | None:
        return self._read(sorted(self._state().values()))

    def merge(self, rows: DataFrame) -> None:
        """Merging the same rows again changes nothing. Null keys are one key."""
        state = self._state()
        placed = rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))
        row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
        newest = lambda df: df.groupBy("_bucket", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.key)]).agg(F.max_by(row, F.struct(*self.age)).alias("_row")).select("_bucket", "_row.*")
        mine = cut_lineage(newest(placed))
        touched = [r[0] for r in mine.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
        old = self._read([state[str(b)] for b in touched if str(b) in state])
        if old is not None:
            mine = newest(mine.unionByName(old.select(*rows.columns).withColumn("_bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))))
        version = f"v-{uuid.uuid4().hex}"
        mine.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{version}")
        replaced = [state[str(b)] for b in touched if str(b) in state]
        state |= {str(b): f"{version}/_bucket={b}" for b in touched}
        self._pointer.publish(json.dumps(state))
        for path in replaced:
            self._pointer.remove(f"{self.folder}/{path}")


class Pointer:
    """A small text in a shared folder of any Hadoop file system that is replaced at once, by renaming."""

    def __init__(self, spark: SparkSession, folder: str, name: str = "CURRENT"):
        self.folder, self.name = folder.rstrip("/"), name
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        self._files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)

    def _path(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path.getFileSystem(self._conf).makeQualified(path)

    def read(self) -> str | None:
        """The text, None before the first."""
        place = self._path(self.name)
        if not self._files.util().exists(place):
            return None
        source = self._files.open(place)
        try:
            return bytes(source.readAllBytes()).decode("utf-8")
        finally:
            source.close()

    def publish(self, text: str) -> None:
        """A failure before the rename leaves the old text."""
        fs = self._jvm.org.apache.hadoop.fs
        made = self._path(f"{self.name}.{uuid.uuid4().hex}")
        out = made.getFileSystem(self._conf).create(made, True)
        out.write(text.encode("utf-8"))
        out.close()
        replace = self._gateway.new_array(fs.Options.Rename, 1)
        replace[0] = fs.Options.Rename.OVERWRITE
        self._files.rename(made, self._path(self.name), replace)

    def remove(self, folder: str) -> None:
        """Removes a folder of the same file system and all in it; none is no fault."""
        self._files.delete(self._jvm.org.apache.hadoop.fs.Path(folder), True)


class Snapshots:
    """Versions of a table in a shared folder: written whole, then made current by a pointer. ``keep`` versions before it stay for readers."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 1):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep
        self._pointer = Pointer(spark, folder)

    def _versions(self) -> list[str]:
        return (self._pointer.read() or "").split()

    def current(self) -> DataFrame | None:
        """The current version, None before the first."""
        versions = self._versions()
        return self.spark.read.parquet(f"{self.folder}/{versions[0]}") if versions else None

    def publish(self, df: DataFrame) -> None:
        """A failure before the pointer is renamed leaves the old version current; versions older than ``keep`` are removed after it."""
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{version}")
        versions = [version, *self._versions()]
        self._pointer.publish(" ".join(versions[: self.keep + 1]))
        for old in versions[self.keep + 1 :]:
            self._pointer.remove(f"{self.folder}/{old}")
