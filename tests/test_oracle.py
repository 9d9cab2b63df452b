"""Every registered query against its SQL in another engine."""

from __future__ import annotations

import math

import duckdb
import pytest

from voxelloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def settled(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(settled(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def test_all_have_sql():
    assert registry.QUERIES.keys() == registry.ORACLE_SQL.keys()


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_same_rows(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    cursor = duck.execute(registry.ORACLE_SQL[name])
    want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    got = rows_of(df.columns, df.collect())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]) > 0
    for a, b in zip(got[1], want[1], strict=True):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-9) if all(isinstance(v, int | float) for v in a) else a == b
