"""Every query with an oracle, on the smallest tables, against DuckDB."""

import datetime
import math
import os

import duckdb
import pytest

from kairoscope import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v.isoformat() if isinstance(v, datetime.date | datetime.datetime) else v


def as_rows(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    got = as_rows(df.columns, df.collect())
    if name not in plans.ORACLES:
        assert got
        return
    cursor = duck.execute(plans.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == as_rows(columns, cursor.fetchall())


def test_whole_tables_are_covered(spark):
    from kairoscope.plans.harness import h_pit, h_signal

    assert plans.QUERIES["wide_vintage_unpivot_all"](spark, SF).count() == h_pit(spark, SF).count()
    got = plans.QUERIES["execution_availability_all"](spark, SF).collect()
    assert len(got) == h_signal(spark, SF).count()
