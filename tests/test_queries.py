"""Every registered query against its SQL form in DuckDB, and the contract of the entry module."""

from __future__ import annotations

from itertools import product

import duckdb
import pytest

import __spark_entry__ as entry
from furrow.config import TreeGrid

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def ordered(rows, columns):
    positions = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in positions)) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    got = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = duck.execute(sql)
    columns = [c[0] for c in cursor.description]
    expected = cursor.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert ordered(got, df.columns) == ordered(expected, columns)


def test_tree_queries_fit_the_whole_grid(spark):
    grid, build = TreeGrid(), entry.queries()
    fits = [(r["max_depth"], r["learning_rate"], r["n_estimators"], r["fold_year"])
            for r in build["model_train"](spark, SF_DIR).collect()]
    years = {fit[3] for fit in fits}
    assert len(years) == 2 and sorted(fits) == sorted(product(grid.depths, grid.rates, grid.rounds, years))
    assert build["feature_importance"](spark, SF_DIR).count() == 5
    scored = build["model_score"](spark, SF_DIR).collect()
    assert {r["year"] for r in scored} == {max(years) + 1} and "boosted trees" in {r["model_type"] for r in scored}


def test_entry(spark):
    assert entry.entry(spark).count() == 10 * 7 * 27


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
