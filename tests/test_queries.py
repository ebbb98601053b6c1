"""Every query with an SQL twin against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tapeflow.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return c


def cell(v):
    if v is None or v is pd.NaT or v != v:
        return ""
    try:
        return f"{float(v) + 0.0:.5f}" if not isinstance(v, bool) else str(v)
    except (TypeError, ValueError):
        return str(v)


def rows(names, data):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in at) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    want = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    got, expected = rows(df.columns, df.collect()), rows(names, want.fetchall())
    assert len(got) == len(expected)
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).columns
    assert catalog.QUERIES[name](spark, sf_dir).count() >= 0


def test_entry_without_llm(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    module = importlib.reload(importlib.import_module("__spark_entry__"))
    try:
        assert "window_ohlcv" in module.queries()
        assert not any(k.startswith("op") and k[2].isdigit() for k in module.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(module)
