"""Every query against its SQL twin in DuckDB."""

import math
import os

import duckdb
import pytest

from krunch.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return connection


def _plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, duck, name):
    frame = catalog.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted(repr([_plain(r[c]) for c in columns]) for r in frame.collect())
    if name not in catalog.oracle_sql():
        assert got
        return
    cursor = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(repr([_plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in cursor.fetchall())
    assert sorted(names) == columns and got == want


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
