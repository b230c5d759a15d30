"""Every registered query against its DuckDB oracle on the smallest tables."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest

from cataloom import registry
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    held = duckdb.connect()
    for t in TABLES:
        held.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return held


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    out = QUERIES[name](spark, SMALL)
    rows = [tuple(plain(r[c]) for c in sorted(out.columns)) for r in out.collect()]
    if name not in ORACLES:
        assert out.columns
        return
    held = db.execute(ORACLES[name])
    columns = [d[0] for d in held.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    expected = [tuple(plain(r[i]) for i in order) for r in held.fetchall()]
    assert [columns[i] for i in order] == sorted(out.columns)
    assert sorted(rows, key=repr) == sorted(expected, key=repr)


def test_every_query_names_its_operators():
    assert set(registry.operators()) == set(QUERIES) and all(registry.operators().values())
