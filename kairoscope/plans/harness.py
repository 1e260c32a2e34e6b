"""Relations that the queries derive from the driver's tables, for both engines.

``REL`` has each relation as DuckDB SQL; the functions build the same in Spark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import at_time, lin_map, next_weekday

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

REL = {
    "h_obs": """SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS d,
        round(avg(o_totalprice), 6) AS v FROM orders GROUP BY 1, 2""",
    "h_week": """SELECT series_id, CAST(date_trunc('week', d) AS DATE) AS w, max(d) AS d, arg_max(v, d) AS v
        FROM h_obs GROUP BY 1, 2""",
    "h_price": """SELECT CAST(o_orderdate AS DATE) AS d, round(avg(o_totalprice), 6) AS close FROM orders GROUP BY 1""",
    "h_anchor": """SELECT DISTINCT series_id, CAST(date_trunc('week', d) AS DATE) + 2 AS d FROM h_obs""",
    "h_rate": """SELECT d, round(close / 100000, 6) AS rate FROM h_price WHERE isodow(d) <> 3""",
    "h_vix": """SELECT d, round(close / 10000, 6) AS v FROM h_price WHERE isodow(d) <> 5""",
    "h_pit": """SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS obs_date,
        CAST(o_orderdate AS DATE) + CAST(l_linenumber AS INTEGER) AS vintage_date,
        CAST(CAST(o_orderdate AS DATE) + CAST(l_linenumber AS INTEGER) AS TIMESTAMP) + INTERVAL 86399 SECOND AS released_at,
        max(l_extendedprice) AS value
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4""",
    "h_signal": """SELECT row_number() OVER (ORDER BY w) AS idx, d, score, ret13, CAST(d AS TIMESTAMP) + INTERVAL 79200 SECOND AS decision_at,
        CAST(d + (CASE isodow(d) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END)::INTEGER AS TIMESTAMP) + INTERVAL 52200 SECOND AS tradable_at,
        CASE WHEN score > 55 THEN 'BULLISH' WHEN score < 45 THEN 'BEARISH' ELSE 'NEUTRAL' END AS verdict,
        CASE WHEN score > 60 THEN 1.0 WHEN score > 50 THEN 0.75 WHEN score > 40 THEN 0.5 ELSE 0.25 END::DOUBLE AS target_exposure
        FROM (SELECT w, d, round(greatest(0, least(100, (close - 150000) / 200000 * 100)), 6) AS score,
              round(close / 1000, 0) AS ret13
              FROM (SELECT CAST(date_trunc('week', d) AS DATE) AS w, max(d) AS d, arg_max(close, d) AS close FROM h_price GROUP BY 1))""",
    "h_pairs": """SELECT s.d, s.score, s.verdict, s.target_exposure, p.d AS outcome_d, p.close / b.close - 1 AS fwd
        FROM h_signal s JOIN h_price b ON b.d = s.d ASOF JOIN h_price p ON p.d >= s.d + 91
        WHERE p.d - (s.d + 91) <= 14""",
    "h_factor": """SELECT series_id AS factor, w, d, round(greatest(0, least(100, (v - 150000) / 200000 * 100)), 6) AS f FROM h_week""",
}
NEEDS = {
    "h_week": ["h_obs"], "h_anchor": ["h_obs"], "h_rate": ["h_price"], "h_vix": ["h_price"], "h_signal": ["h_price"],
    "h_pairs": ["h_price", "h_signal"], "h_factor": ["h_obs", "h_week"],
}


def with_(names: str, body: str) -> str:
    """DuckDB SQL with the named relations (and what they need) in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    body = body.strip()
    if not order:
        return body
    ctes = ", ".join(f"{n} AS ({REL[n]})" for n in order)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


def query(name: str, relations: str = "", sql: str | None = None):
    """Registers a query and, if SQL can express it, its oracle."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_(relations, sql)
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def h_obs(spark, sf) -> DataFrame:
    orders = table(spark, sf, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("d")).agg(F.round(F.avg("o_totalprice"), 6).alias("v"))


def h_week(spark, sf) -> DataFrame:
    week = F.date_trunc("week", "d").cast("date").alias("w")
    return h_obs(spark, sf).groupBy("series_id", week).agg(F.max("d").alias("d"), F.max_by("v", "d").alias("v"))


def h_price(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.round(F.avg("o_totalprice"), 6).alias("close"))


def h_anchor(spark, sf) -> DataFrame:
    return h_obs(spark, sf).select("series_id", F.date_add(F.date_trunc("week", "d").cast("date"), 2).alias("d")).distinct()


def h_rate(spark, sf) -> DataFrame:
    return h_price(spark, sf).where(F.weekday("d") != 2).select("d", F.round(F.col("close") / 100000, 6).alias("rate"))


def h_vix(spark, sf) -> DataFrame:
    return h_price(spark, sf).where(F.weekday("d") != 4).select("d", F.round(F.col("close") / 10000, 6).alias("v"))


def h_pit(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.to_date("o_orderdate").alias("obs_date"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("vintage_date", F.expr("date_add(obs_date, l_linenumber)"))
    rows = rows.groupBy(F.col("o_orderpriority").alias("series_id"), "obs_date", "vintage_date").agg(F.max("l_extendedprice").alias("value"))
    return rows.select("series_id", "obs_date", "vintage_date", at_time("vintage_date", "23:59:59").alias("released_at"), "value")


def h_signal(spark, sf) -> DataFrame:
    from pyspark.sql import Window as W

    week = F.date_trunc("week", "d").cast("date").alias("w")
    rows = h_price(spark, sf).groupBy(week).agg(F.max("d").alias("d"), F.max_by("close", "d").alias("close"))
    rows = rows.withColumn("score", F.round(lin_map("close", 150000, 350000), 6)).withColumn("idx", F.row_number().over(W.orderBy("w")).cast("long"))
    s = F.col("score")
    return rows.select(
        "idx", "d", "score", F.round(F.col("close") / 1000, 0).alias("ret13"), at_time("d", "22:00:00").alias("decision_at"),
        at_time(next_weekday("d"), "14:30:00").alias("tradable_at"),
        F.when(s > 55, "BULLISH").when(s < 45, "BEARISH").otherwise("NEUTRAL").alias("verdict"),
        F.when(s > 60, 1.0).when(s > 50, 0.75).when(s > 40, 0.5).otherwise(0.25).alias("target_exposure"),
    )


def h_pairs(spark, sf) -> DataFrame:
    from ..operators.labels import forward_pairs

    got = forward_pairs(h_signal(spark, sf), h_price(spark, sf), days=91, tolerance=14, keys=[])
    return got.select("d", "score", "verdict", "target_exposure", "outcome_d", "fwd")


def h_factor(spark, sf) -> DataFrame:
    return h_week(spark, sf).select(F.col("series_id").alias("factor"), "w", "d", F.round(lin_map("v", 150000, 350000), 6).alias("f"))


def r6(c, name: str):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)
