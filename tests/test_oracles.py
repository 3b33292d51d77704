"""Every query of the core library that has SQL, against DuckDB."""

import math

import duckdb
import pytest

from snapforge.jobs import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "customer documents embeddings events lineitem nation orders part region supplier".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    cell = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) else str(v)
    return sorted(repr(tuple(cell(v) for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    found = catalogue.QUERIES[name](spark, SF)
    wanted = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in wanted.description]
    assert sorted(names) == sorted(found.columns)
    assert plain(found.select(*names).collect()) == plain(wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
