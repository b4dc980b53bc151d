"""Every query of the catalog against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from quarry.queries import catalog
from quarry.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t)}.parquet')")
    return con


def normal(rows):
    def value(v):
        v = v.item() if hasattr(v, "item") else v
        if isinstance(v, float):
            return "" if math.isnan(v) else f"{v:.9g}"
        return "" if v is None else str(v)

    return sorted(tuple(map(value, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    found = duck.execute(catalog.SQL[name])
    columns, rows = [d[0] for d in found.description], found.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.select(columns).collect()) == normal(rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
