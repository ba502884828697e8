"""Every registered query of the cube engine against DuckDB on the same files."""

import datetime
import decimal
from collections import Counter

import duckdb
import pytest

from starlode import bi  # noqa: F401
from starlode.queries import DUCK, SPARK
from starlode.sources.tables import NAMES


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in NAMES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SPARK))
def test_query(spark, sf, duck, name):
    df = SPARK[name](spark, sf)
    columns = sorted(df.columns)
    rows = Counter(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in DUCK:
        assert rows
        return
    r = duck.sql(DUCK[name])
    assert columns == sorted(r.columns)
    order = [r.columns.index(c) for c in columns]
    assert rows == Counter(repr([plain(x[i]) for i in order]) for x in r.fetchall())
