"""Every query of the core with oracle SQL gives the rows that DuckDB gives (smallest tables)."""

import importlib.util
import math
import os
import sys

import pytest

from corpusloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "as_tuple"):
        return float(f"{float(v):.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    got = sorted(str(tuple(map(plain, r))) for r in df.select(*cols).collect())
    assert got == sorted(str(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


def test_queries_without_oracles_run(spark):
    for name in sorted(registry.queries().keys() - registry.oracle_sql().keys()):
        assert registry.queries()[name](spark, SF).count() > 0


def test_entry_without_the_corpus_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("corpusloom.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("corpusloom.llm", "corpus_pipeline") else find(name, *a))
    entry = importlib.import_module("__spark_entry__")
    assert not [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
