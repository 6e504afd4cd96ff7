"""Every registered query against its SQL in DuckDB, row by row, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from docmill.plans import catalog

SMALL = "/root/testdata/sf0.001"


def rows(frame, columns):
    plain = lambda x: None if pd.isna(x) else round(float(x), 5) if isinstance(x, float) else x
    return sorted(repr([plain(x) for x in r]) for r in frame[columns].astype(object).values.tolist())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    got, want = catalog.QUERIES[name](spark, SMALL).toPandas(), con.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_queries_without_sql(spark):
    """Quotes are grounded by an alignment, which tests/test_spans.py holds against brute force; the chain of decisions is a fold over
    lines, with golden rows in tests/test_decided.py."""
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"quote_grounding", "decision_chain"}
    assert catalog.QUERIES["decision_chain"](spark, SMALL).where("confidence >= 0.6").count() > 0
    how = {r.how: r["count"] for r in catalog.QUERIES["quote_grounding"](spark, SMALL).groupBy("how").count().collect()}
    assert how["exact"] > 20 and how["fuzzy"] > 20 and how["span_unresolved"] + how.get("offset_mismatch", 0) > 20


def test_entry_and_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(SMALL):
        assert entry.entry(spark).count() > 0


def test_a_callers_views_stay(spark):
    """Statements name their tables; a view of the caller's under such a name is neither read nor lost."""
    mine = spark.createDataFrame([(1,)], "x int")
    for name in ("documents", "pages", "lineitem"):
        mine.createOrReplaceTempView(name)
    before = {t.name for t in spark.catalog.listTables()}
    for name in ("hash_ids", "crawl_bfs", "semantic_boost"):
        assert catalog.QUERIES[name](spark, SMALL).count() > 1
    assert {t.name for t in spark.catalog.listTables()} == before
    assert spark.table("documents").columns == spark.table("pages").columns == ["x"]
    for name in ("documents", "pages", "lineitem"):
        spark.catalog.dropTempView(name)
