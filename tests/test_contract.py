"""The driver's contract: every query runs, and agrees with its SQL where it has one."""

import math

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_agrees_with_sql(spark, duck, name):
    got = contract.queries()[name](spark, SF)
    found = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(names)
    want = sorted((tuple(plain(x) for x in r) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=repr) == want


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1
