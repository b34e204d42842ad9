"""Every registered query of the core against its SQL twin on the smallest tables."""

import glob
import os

import duckdb
import pytest

from gneiss.plans import registry

DATA = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return connection


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got or name in ("corrupt_pages", "merge_run_conflicts", "reused_texts", "campaign_faults")
    if name in registry.oracle_sql():
        cursor = duck.execute(registry.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)


def test_flagship(spark):
    assert registry.flagship(spark, DATA).count() > 5
