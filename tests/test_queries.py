"""Each query with SQL against that SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from gridrecon.plans import catalogue, clauses, drawn, extraction, files, running, sheets, streams, subtables  # noqa: F401

SF = "/root/testdata/sf0.001"


def norm(rows):
    return sorted(tuple("-" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.select(*sorted(got.columns)).collect()]
    if name in catalogue.ORACLES:
        want = con.sql(catalogue.ORACLES[name])
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        assert norm(rows) == norm(con.sql(f"select {', '.join(cols)} from ({catalogue.ORACLES[name]})").fetchall())
    else:
        assert rows


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_greedy_is_one_to_one(spark):
    m = catalogue.QUERIES["subtable_greedy_match"](spark, SF)
    used = m.where("how in ('exact', 'all', 'any')")
    assert used.count() == used.select("doc", "est_ord").distinct().count()
