"""Queries over whole tables, beside those that are fixed to a series, a range or a horizon; and scores without a table of their own."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import scores as C
from ..operators import asof as A
from ..operators import stats as X
from ..operators.labels import forward_pairs
from ..sources import readers as R
from ..sources import sinks as K
from .evaluation import SPEARMAN
from .harness import h_factor, h_pit, h_price, h_signal, h_week, query, r6


@query("pit_frames_all", "h_pit h_signal", """
    WITH f AS (SELECT e.d AS model_date, p.* FROM h_signal e JOIN h_pit p ON p.released_at <= e.decision_at AND p.obs_date <= e.d
        QUALIFY row_number() OVER (PARTITION BY e.d, p.series_id, p.obs_date ORDER BY p.vintage_date DESC, p.released_at DESC) = 1)
    SELECT model_date, series_id, CAST(count(*) AS BIGINT) AS n, max(obs_date) AS last_obs, arg_max(value, obs_date) AS last_value, max(released_at) AS data_cutoff, round(sum(value), 2) AS total FROM f GROUP BY 1, 2""")
def pit_frames_all(spark, sf):
    """What each weekly decision could see of each series."""
    events = h_signal(spark, sf).select(F.col("d").alias("model_date"), "decision_at")
    rows = A.bitemporal_frames(h_pit(spark, sf), events, key=["series_id", "obs_date"])
    return rows.groupBy("model_date", "series_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("obs_date").alias("last_obs"), F.max_by("value", "obs_date").alias("last_value"), F.max("released_at").alias("data_cutoff"),
        F.round(F.sum("value"), 2).alias("total"),
    )


@query("first_vintage_events_all", "h_pit", """
    SELECT series_id, obs_date AS model_date, vintage_date, released_at AS decision_at FROM h_pit QUALIFY row_number() OVER (PARTITION BY series_id, obs_date ORDER BY vintage_date, released_at) = 1""")
def first_vintage_events_all(spark, sf):
    """The first vintage of each observation of each series as a decision."""
    rows = A.latest_visible(h_pit(spark, sf), ["series_id", "obs_date"], [F.col("vintage_date"), F.col("released_at")], F.lit(True))
    return rows.select("series_id", F.col("obs_date").alias("model_date"), "vintage_date", F.col("released_at").alias("decision_at"))


#: Release rules of each series; the third has two at once for a year, the fourth none after 2000.
RULES = [
    ("1-URGENT", "1900-01-01", "2100-01-01", "08:30"), ("2-HIGH", "1900-01-01", "1998-01-01", "08:30"), ("2-HIGH", "1998-01-02", "2100-01-01", "16:30"),
    ("3-MEDIUM", "1900-01-01", "1999-12-31", "10:00"), ("3-MEDIUM", "1999-01-01", "2100-01-01", "10:15"), ("4-NOT SPECIFIED", "1900-01-01", "2000-12-31", "12:00"), ("5-LOW", "1900-01-01", "2100-01-01", "16:00"),
]
_RULES = ", ".join(f"('{s}', DATE '{a}', DATE '{b}', '{t}')" for s, a, b, t in RULES)


@query("release_rules_all", "h_pit", f"""
    WITH r(series_id, a, b, release_time) AS (VALUES {_RULES}), x AS (SELECT p.series_id, p.obs_date, p.vintage_date, count(r.a) AS n, min(release_time) AS t FROM h_pit p LEFT JOIN r ON r.series_id = p.series_id AND p.vintage_date BETWEEN a AND b GROUP BY 1, 2, 3)
    SELECT series_id, obs_date, vintage_date, CASE WHEN n = 1 THEN t END AS release_time, CASE WHEN n = 0 THEN 'NO_RULE' WHEN n > 1 THEN 'SEVERAL_RULES' END AS issue FROM x""")
def release_rules_all(spark, sf):
    """The one release rule of each vintage of each series, or why there is not exactly one."""
    rules = spark.createDataFrame(RULES, "series_id string, a string, b string, release_time string")
    rules = rules.select("series_id", F.to_date("a").alias("valid_from"), F.to_date("b").alias("valid_to"), "release_time")
    rows = R.release_rules(h_pit(spark, sf), rules).groupBy("series_id", "obs_date", "vintage_date").agg(F.max("n_rules").alias("n"), F.min("release_time").alias("t"))
    issue = F.when(F.col("n") == 0, "NO_RULE").when(F.col("n") > 1, "SEVERAL_RULES")
    return rows.select("series_id", "obs_date", "vintage_date", F.when(issue.isNull(), F.col("t")).alias("release_time"), issue.alias("issue"))


@query("frozen_weeks_all", "h_week", """
    SELECT series_id, w AS week, CASE WHEN week(w) % 5 = 0 THEN v + 1 ELSE v END AS v, false AS legacy FROM h_week""")
def frozen_weeks_all(spark, sf):
    """Weeks of each series: frozen ones stay, legacy ones are replaced, missing ones added."""
    rows = h_week(spark, sf).select("series_id", F.col("w").alias("week"), "v")
    week = F.weekofyear("week")
    old = rows.withColumn("legacy", week % 5 == 0).where(week % 7 != 3)
    new = rows.select("series_id", "week", F.when(week % 5 == 0, F.col("v") + 1).otherwise(F.col("v")).alias("v"), F.lit(False).alias("legacy"))
    return K.freeze_weeks(old, new, ["series_id", "week"])


@query("factor_ic_horizons", "h_factor h_signal h_price", """
    WITH hp AS (SELECT weeks, s.d, p.close / b.close - 1 AS fwd FROM (SELECT * FROM h_signal CROSS JOIN (VALUES (4), (8), (13)) h(weeks)) s JOIN h_price b ON b.d = s.d ASOF JOIN h_price p ON p.d >= s.d + 7 * s.weeks WHERE p.d - (s.d + 7 * s.weeks) <= 14),
    fp AS (SELECT f.factor || '|' || weeks AS g, f.f, fwd FROM h_factor f JOIN hp ON CAST(date_trunc('week', hp.d) AS DATE) = f.w), i AS (""" + SPEARMAN.format(k="g", x="f", y="fwd", t="fp", empty="0") + """)
    SELECT split_part(g, '|', 1) AS factor, CAST(split_part(g, '|', 2) AS INTEGER) AS weeks, n, ic FROM i""")
def factor_ic_horizons(spark, sf):
    """ICs of each factor at each of three horizons."""
    signals, prices, f = h_signal(spark, sf), h_price(spark, sf), h_factor(spark, sf)
    pairs = None
    for weeks in (4, 8, 13):
        part = forward_pairs(signals, prices, days=7 * weeks, tolerance=14, keys=[]).select(F.lit(weeks).alias("weeks"), F.date_trunc("week", "d").cast("date").alias("w"), "fwd")
        pairs = part if pairs is None else pairs.unionByName(part)
    return X.spearman(f.join(pairs, "w"), "f", "fwd", ["factor", "weeks"]).select("factor", "weeks", "n", r6("ic", "ic"))


_LIN = lambda x, a, b: f"CASE WHEN {x} IS NOT NULL THEN greatest(0, least(100, ({x} - {a}) / {b - a} * 100)) END"


@query("score_primitives", "h_week", f"""
    WITH x AS (SELECT series_id, w, v / 50 AS level, (v - lag(v, 13) OVER (PARTITION BY series_id ORDER BY w)) / 100 AS change, CASE WHEN day(w) % 3 <> 0 THEN (v - 150000) / 1000000 END AS spread, CASE WHEN day(w) % 7 <> 0 THEN v / 5000 END AS vix FROM h_week),
    y AS (SELECT *, {_LIN("level", 2800.0, 3800.0)} AS l, {_LIN("change", -300.0, 300.0)} AS c, {_LIN("spread", 0.1, 0.0)} AS f FROM x)
    SELECT series_id, w, round(l * 0.5 + coalesce(c, 50) * 0.3 + coalesce(f, 50) * 0.2, 6) AS reserve, round((l * 0.5 + coalesce(c * 0.3, 0) + coalesce(f * 0.2, 0)) / (0.5 + CASE WHEN c IS NULL THEN 0 ELSE 0.3 END + CASE WHEN f IS NULL THEN 0 ELSE 0.2 END), 6) AS available_reserve,
        CASE WHEN vix IS NULL THEN 'UNKNOWN' WHEN vix >= 28 THEN 'STRESSED' ELSE 'NORMAL' END AS stress, round(CASE WHEN vix > 20 THEN vix / 10 ELSE vix END, 3) AS scaled_yield, round(level / nullif(change, 0) - 1, 4) AS ratio FROM y""")
def score_primitives(spark, sf):
    """The full and the available reserve score, the volatility stress, a yield brought to its scale and a relative change."""
    w = h_week(spark, sf)
    change = (F.col("v") - F.lag("v", 13).over(W.partitionBy("series_id").orderBy("w"))) / 100
    x = w.select(
        "series_id", "w", (F.col("v") / 50).alias("level"), change.alias("change"), F.when(F.dayofmonth("w") % 3 != 0, (F.col("v") - 150000) / 1000000).alias("spread"),
        F.when(F.dayofmonth("w") % 7 != 0, F.col("v") / 5000).alias("vix"),
    )
    funding = C.funding_score("spread")
    return x.select(
        "series_id", "w", r6(C.reserve_score("level", "change", funding), "reserve"), r6(C.available_reserve_score("level", "change", funding), "available_reserve"),
        C.vix_stress("vix").alias("stress"), F.round(C.yield_scale("vix"), 3).alias("scaled_yield"), F.round(S.ratio_change("level", "change"), 4).alias("ratio"),
    )
