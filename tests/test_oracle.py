"""Every registered query of the engine against its SQL in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from paragraf import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = plans.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows_of(names, order, rows):
    return sorted((tuple(plain(r[names.index(c)]) for c in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, sf_dir, name):
    df = plans.queries()[name](spark, sf_dir)
    found = duck.sql(SQL[name])
    order = sorted(df.columns)
    assert order == sorted(found.columns)
    assert rows_of(df.columns, order, df.collect()) == rows_of(found.columns, order, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert plans.queries()[name](spark, sf_dir).count() > 0


def test_registration():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.queries()) <= set(entry.queries())
    assert os.path.basename(entry.__file__) == "__spark_entry__.py"


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
