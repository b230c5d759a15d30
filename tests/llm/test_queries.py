"""Each query over the whole of a small table, against its oracle where SQL has one."""

from __future__ import annotations

import duckdb
import pytest

from cataloom.llm import queries as Q
from tests.conftest import SMALL

TABLES = {"op3_html_extraction": "pages", "op5_exact_topk": None, "op4_source_mixing": None}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    out = Q.queries()[name](spark, SMALL)
    rows = [tuple(r[c] for c in sorted(out.columns)) for r in out.collect()]
    table = TABLES.get(name, "documents")
    if table:
        assert len(rows) == spark.read.parquet(f"{SMALL}/{table}.parquet").count()
    if name in Q.ORACLES:
        db = duckdb.connect()
        for t in ("documents", "embeddings", "pages"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        held = db.execute(Q.ORACLES[name])
        order = sorted(range(len(held.description)), key=lambda i: held.description[i][0])
        assert [held.description[i][0] for i in order] == sorted(out.columns)
        assert sorted(tuple(r[i] for i in order) for r in held.fetchall()) == sorted(rows)
