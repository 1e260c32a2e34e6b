"""Queries over files: payloads and pages are written from the driver's tables to the shared folder and read back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from ..sources import paged, verified
from ..sources import readers as R
from .harness import h_obs, h_pit, h_week, query, r6, table


def _through_files(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` (key, payload) written as one text file for each key and read back whole."""
    path = scratch(rows.sparkSession, name)
    rows.select(key, F.col("payload").alias("value")).repartition(key).write.partitionBy(key).text(path)
    got = rows.sparkSession.read.option("wholetext", True).text(path)
    return got.select(F.col(key).cast("string").alias(key), F.col("value").alias("payload"))


@query("paged_vintages", "h_pit", "SELECT series_id, obs_date, vintage_date, value FROM h_pit")
def paged_vintages(spark, sf):
    """The vintages recorded as pages of 1,000 rows in windows of 500 days, and read by the data source, each page at the second attempt."""
    pit = h_pit(spark, sf).select("series_id", "obs_date", "vintage_date", "value")
    ends = pit.agg(F.min("vintage_date"), F.max("vintage_date")).first()
    if ends[0] is None:
        return pit
    path, series = scratch(spark, "pages"), [r[0] for r in pit.select("series_id").distinct().collect()]  # the configured series
    paged.record_pages(pit, path, first=ends[0], last=ends[1], window_days=500, page_rows=1000)
    spark.dataSource.register(paged.PagedVintages)
    options = {"path": path, "series": json.dumps(series), "first": str(ends[0]), "last": str(ends[1]), "window_days": "500", "faults": "1"}
    return spark.read.format("paged_vintages").options(**options).load()


@query("verified_series", "h_obs", "SELECT series_id, count(*) AS n, min(d) AS first, max(d) AS last, round(sum(v), 3) AS total FROM h_obs GROUP BY 1")
def verified_series(spark, sf):
    """Series written once with their manifest, and read only if files and rows are those of it."""
    path = scratch(spark, "verified")
    verified.write_once(h_obs(spark, sf), path)
    rows = verified.read_verified(spark, path)
    return rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first"), F.max("d").alias("last"), F.round(F.sum("v"), 3).alias("total"))


@query("quote_files", "h_week", """
    SELECT series_id || '|' || w AS symbol, CASE WHEN day(w) <> 6 THEN v END AS price, CAST(d AS TIMESTAMP) + INTERVAL 20 HOUR AS at, CASE WHEN day(w) < 10 THEN 'REGULAR' WHEN day(w) < 20 THEN 'CLOSED' ELSE 'UNKNOWN' END AS state FROM h_week WHERE w >= DATE '2001-01-01' OR day(w) = 6""")
def quote_files(spark, sf):
    """Quotes of chart payloads, a file for each."""
    state = F.when(F.dayofmonth("w") < 10, "REGULAR").when(F.dayofmonth("w") < 20, "CLOSED").otherwise("HALTED")
    meta = F.struct(
        F.when(F.dayofmonth("w") == 6, "none").otherwise(F.col("v").cast("string")).alias("regularMarketPrice"), (F.unix_date("d").cast("long") * 86400 + 72000).alias("regularMarketTime"),
        state.alias("marketState"),
    )
    payload = F.to_json(F.struct(F.struct(F.array(F.struct(meta.alias("meta"))).alias("result")).alias("chart")))
    rows = h_week(spark, sf).where("w >= date'2001-01-01' or day(w) = 6").select(F.concat_ws("|", "series_id", F.col("w").cast("string")).alias("symbol"), payload.alias("payload"))
    return R.quote_json(_through_files(rows, "symbol", "quotes"))


@query("daily_array_files", "h_obs", "SELECT series_id AS symbol, d, v AS close FROM h_obs WHERE day(d) <> 17")
def daily_array_files(spark, sf):
    """Daily closes of chart payloads that hold two arrays, a file for each series and year."""
    years = h_obs(spark, sf).groupBy("series_id", F.year("d").alias("y")).agg(F.array_sort(F.collect_list(F.struct((F.unix_date("d").cast("long") * 86400).alias("t"), F.when(F.dayofmonth("d") != 17, F.col("v")).alias("c")))).alias("a"))
    arrays = F.struct(F.transform("a", lambda x: x["t"]).alias("timestamp"), F.transform("a", lambda x: x["c"]).alias("close"))
    rows = years.select(F.concat_ws("|", "series_id", F.col("y").cast("string")).alias("file"), F.to_json(arrays, {"ignoreNullFields": "false"}).alias("payload"))
    parsed = F.from_json("payload", "struct<timestamp:array<bigint>,close:array<double>>")
    got = _through_files(rows, "file", "arrays").select(F.split("file", r"\|")[0].alias("symbol"), parsed["timestamp"].alias("ts"), parsed["close"].alias("close"))
    return R.daily_arrays(got)


@query("operation_files", "", """
    SELECT CAST(o_orderdate AS DATE) AS d, round(sum(o_totalprice) / 1000000000, 6) AS v FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderdate >= DATE '1998-01-01' GROUP BY 1""")
def operation_files(spark, sf):
    """Overnight operations of a month's file, summed by day; other terms and days before the first are left out."""
    orders = table(spark, sf, "orders").where("o_orderdate >= date'1997-12-01'")
    one = F.struct(
        F.to_date("o_orderdate").cast("string").alias("operationDate"), F.lit("Repo").alias("operationType"), F.when(F.col("o_orderpriority") == "5-LOW", "Term").otherwise("Overnight").alias("term"),
        F.col("o_totalprice").alias("totalAmtAccepted"),
    )
    # a file holds the orders of one customer's hundred in a month, as a service's page would
    page = F.concat_ws("|", F.date_format("o_orderdate", "yyyy-MM"), F.floor(F.col("o_custkey") / 5000).cast("string"))
    months = orders.groupBy(page.alias("page")).agg(F.collect_list(one).alias("operations"))
    rows = months.select("page", F.to_json(F.struct(F.struct("operations").alias("repo"))).alias("payload"))
    return R.operations_json(_through_files(rows, "page", "operations"), "1998-01-01").select("d", r6("v", "v"))
