"""Queries with an oracle, on small tables of odd rows, against DuckDB."""

import datetime
import re

import duckdb
import pytest
from test_oracles import as_rows

from kairoscope import plans

ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


def weekly(*prices):
    """An order a week."""
    day = lambda i: datetime.datetime(2000, 1, 5) + datetime.timedelta(7 * i)
    return [(i, i, "O", p, day(i), "1-URGENT") for i, p in enumerate(prices)]


CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def both(spark, path, name, **tables):
    """The query's rows by Spark and by SQL."""
    con = duckdb.connect()
    for k, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{k}.parquet")
        con.execute(f"CREATE VIEW {k} AS SELECT * FROM '{path}/{k}.parquet/*.parquet'")
    df, cursor = plans.QUERIES[name](spark, str(path)), con.execute(plans.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    return as_rows(df.columns, df.collect()), as_rows(columns, cursor.fetchall())


@pytest.mark.parametrize(
    "prices",
    [(250000.0, 251000.0, 249000.0, 250000.0), (300000.0, 300000.0, 300000.0), (250000.0, 0.0, 0.0, 310000.0, 320000.0), (0.0, 300000.0, 330000.0), (300000.0, 310000.0), (300000.0,), ()],
    ids=["never_held", "held_without_change", "zero_twice", "zero_first", "one_return", "no_return", "empty"],
)
def test_strategy_stats_divides_as_sql_does(spark, tmp_path, prices):
    got, want = both(spark, tmp_path, "strategy_stats", orders=(weekly(*prices), ORDERS))
    assert got == want and len(got) == 1


def test_benjamini_hochberg_on_odd_rows(spark, tmp_path):
    keys = [(k, "A") for k in range(-40, 300)] + [(17, "A"), (5, "A"), (None, "A"), (None, "A"), (None, None), (34, None), (3, None), (17, "one"), (None, "none")]
    got, want = both(spark, tmp_path, "benjamini_hochberg", customer=([(k, "x", 1, 0.0, s) for k, s in keys], CUSTOMER))
    assert got == want and len(got) == len(keys)


def test_benjamini_hochberg_is_not_quadratic(spark):
    # a frame from the current row to the last one is read anew for each row of a family
    plan = plans.QUERIES["benjamini_hochberg"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    frames = re.findall(r"specifiedwindowframe\(\w+, ([^)]*\)), ([^)]*\))\)", plan)
    assert frames and not [f for f in frames if "unboundedfollowing" in f[1] and "unboundedpreceding" not in f[0]]
