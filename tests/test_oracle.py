"""Every registered query outside the corpus operators against its SQL in DuckDB, on the smallest tables."""

import math
import os
import re

import duckdb
import pytest

from annalist import catalog
from annalist.registry import TABLES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    text = lambda x: "nan" if isinstance(x, float) and math.isnan(x) else x.isoformat() if hasattr(x, "isoformat") else repr(x)
    return sorted(tuple(text(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_like_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SMALL)
    want = db.sql(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_entry_without_the_corpus_operators(monkeypatch):
    import importlib.util

    import __spark_entry__ as entry

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("annalist.llm", "corpus_pipeline")) else real(name, *a))
    assert entry.queries() and not any(re.match(r"op\d+_|pipeline$", k) for k in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
