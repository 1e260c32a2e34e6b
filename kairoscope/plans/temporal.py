"""Queries: as-of joins, look-backs, windows, bitemporal frames."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import params as P
from ..functions import scalars as S
from ..functions import scores as C
from ..operators import asof as A
from ..operators import sets as T
from ..operators import windows as N
from .harness import h_anchor, h_obs, h_pit, h_price, h_rate, h_vix, h_week, query, r6, table

KEY = ["series_id"]


@query("net_liquidity_decision", "h_obs h_week", """
    WITH a AS (SELECT d, v FROM h_week WHERE series_id = '1-URGENT'),
    l AS (SELECT a.d, a.v - t.v - r.v AS level FROM a
        ASOF JOIN (SELECT d, v FROM h_obs WHERE series_id = '2-HIGH') t ON a.d >= t.d
        ASOF JOIN (SELECT d, v FROM h_obs WHERE series_id = '3-MEDIUM') r ON a.d >= r.d),
    m AS (SELECT d, level, CASE WHEN count(*) OVER w = 13 THEN avg(level) OVER w END AS sma13, lag(level, 4) OVER (ORDER BY d) AS l4, lag(level, 13) OVER (ORDER BY d) AS l13
        FROM l WINDOW w AS (ORDER BY d ROWS 12 PRECEDING)),
    s AS (SELECT *, CASE WHEN (level - sma13) / greatest(1, abs(sma13)) > 0.002 THEN 'UP'
              WHEN (level - sma13) / greatest(1, abs(sma13)) < -0.002 THEN 'DOWN' ELSE 'FLAT' END AS direction,
          CASE WHEN l13 IS NULL THEN 50 ELSE
              0.5 * (CASE WHEN level > sma13 THEN 60 ELSE 40 END)
              + 0.5 * greatest(0, least(100, (level - l4 + 200) / 400 * 100)) END AS score FROM m),
    b AS (SELECT *, CASE WHEN round(score, 6) > 55 THEN 'BULLISH' WHEN round(score, 6) < 45 THEN 'BEARISH' END AS band FROM s)
    SELECT d, round(level, 6) AS level, round(sma13, 6) AS sma13, direction, round(score, 6) AS score,
        coalesce(last_value(band IGNORE NULLS) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING), 'NEUTRAL') AS verdict FROM b""")
def net_liquidity_decision(spark, sf):
    week, obs = h_week(spark, sf), h_obs(spark, sf)
    pick = lambda df, s: df.where(F.col("series_id") == s).select("d", "v")
    rows = A.align(pick(week, "1-URGENT"), {"tga": pick(obs, "2-HIGH"), "rrp": pick(obs, "3-MEDIUM")})
    rows = rows.select("d", C.net_liquidity("v", "tga", "rrp").alias("level"))
    rows = rows.withColumn("sma13", N.sma("level", 13, [])).withColumn("l4", N.lag("level", 4, [])).withColumn("l13", N.lag("level", 13, []))
    rows = rows.withColumn("direction", C.direction("level", "sma13")).withColumn("score", F.round(C.trend_score("level", "sma13", "l4", "l13"), 6))
    return rows.select("d", r6("level", "level"), r6("sma13", "sma13"), "direction", "score", N.hysteresis(C.band("score"), []).alias("verdict"))


@query("asof_backward", "h_obs h_anchor", """
    SELECT a.series_id, a.d, o.d AS asof_date, o.v AS asof_v FROM h_anchor a
    ASOF LEFT JOIN h_obs o ON a.series_id = o.series_id AND a.d >= o.d""")
def asof_backward(spark, sf):
    return A.asof_last(h_anchor(spark, sf), h_obs(spark, sf), keys=KEY, carry=["v"])


@query("asof_strictly_before", "h_obs", """
    SELECT a.series_id, a.d, o.d AS asof_date, o.v AS asof_v FROM h_obs a
    ASOF LEFT JOIN h_obs o ON a.series_id = o.series_id AND a.d > o.d""")
def asof_strictly_before(spark, sf):
    obs = h_obs(spark, sf)
    return A.asof_last(obs.select("series_id", "d"), obs, keys=KEY, carry=["v"], strict=True)


@query("asof_forward", "h_obs h_anchor", """
    SELECT a.series_id, a.d, o.d AS next_date, o.v AS next_v FROM h_anchor a
    ASOF LEFT JOIN h_obs o ON a.series_id = o.series_id AND a.d <= o.d""")
def asof_forward(spark, sf):
    return A.asof_first(h_anchor(spark, sf), h_obs(spark, sf), keys=KEY, carry=["v"])


@query("asof_forward_strict", "h_obs", """
    SELECT a.series_id, a.d, o.d AS next_date, o.v AS next_v FROM h_obs a
    ASOF LEFT JOIN h_obs o ON a.series_id = o.series_id AND a.d < o.d""")
def asof_forward_strict(spark, sf):
    obs = h_obs(spark, sf)
    return A.asof_first(obs.select("series_id", "d"), obs, keys=KEY, carry=["v"], strict=True)


WEEKDAYS = "(SELECT count(*) FROM range(CAST({0} AS DATE) + 1, CAST({1} AS DATE) + 1, INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6)"


@query("asof_freshness", "h_obs h_anchor", f"""
    WITH m AS (SELECT a.series_id, a.d, o.d AS od, o.v FROM h_anchor a
        ASOF LEFT JOIN h_obs o ON a.series_id = o.series_id AND a.d >= o.d),
    g AS (SELECT *, a.n AS wd FROM m LEFT JOIN LATERAL (SELECT count(*) AS n FROM generate_series(1, coalesce(m.d - m.od, 0)) t(k)
        WHERE isodow(m.od + CAST(k AS INTEGER)) < 6) a ON true)
    SELECT series_id, d, od AS obs_date, CAST(d - od AS BIGINT) AS age,
        CASE WHEN od IS NULL THEN 'MISSING' WHEN d - od > 2 OR wd > 1 THEN 'STALE' ELSE 'FRESH' END AS status,
        CASE WHEN od IS NOT NULL AND NOT (d - od > 2 OR wd > 1) THEN v END AS value FROM g""")
def asof_freshness(spark, sf):
    got = A.asof_last(h_anchor(spark, sf), h_obs(spark, sf), keys=KEY, carry=["v"])
    state = A.fresh(F.col("asof_v"), F.col("asof_date"), F.col("d"), calendar_days=2, business_days=1)
    return got.withColumn("s", state).select("series_id", "d", F.col("s.date").alias("obs_date"), "s.age", "s.status", "s.value")


@query("asof_no_fallback", "h_obs h_anchor", """
    SELECT a.series_id, a.d, CASE WHEN o.d IS NULL THEN 'MISSING' WHEN a.d - o.d > 4 OR o.d <> a.d THEN 'STALE' ELSE 'FRESH' END AS status,
        CASE WHEN o.d = a.d THEN o.v END AS value
    FROM h_anchor a ASOF LEFT JOIN h_obs o ON a.series_id = o.series_id AND a.d >= o.d""")
def asof_no_fallback(spark, sf):
    got = A.asof_last(h_anchor(spark, sf), h_obs(spark, sf), keys=KEY, carry=["v"])
    state = A.fresh(F.col("asof_v"), F.col("asof_date"), F.col("d"), calendar_days=4, fallback=F.lit("NONE"))
    return got.withColumn("s", state).select("series_id", "d", "s.status", "s.value")


@query("asof_tolerance", "h_obs", """
    WITH x AS (SELECT * FROM h_obs WHERE day(d) % 5 = 0), p AS (SELECT series_id, d FROM h_obs WHERE day(d) % 5 IN (1, 3)),
    b AS (SELECT p.*, x.d AS bd, x.v AS bv FROM p ASOF LEFT JOIN x ON p.series_id = x.series_id AND p.d >= x.d),
    f AS (SELECT b.*, x.d AS fd, x.v AS fv FROM b ASOF LEFT JOIN x ON b.series_id = x.series_id AND b.d + 3 >= x.d)
    SELECT series_id, d, CASE WHEN d - bd <= 3 THEN bd WHEN fd >= d THEN fd END AS asof_date,
        CASE WHEN d - bd <= 3 THEN bv WHEN fd >= d THEN fv END AS asof_v FROM f""")
def asof_tolerance(spark, sf):
    obs = h_obs(spark, sf)
    data = obs.where(F.dayofmonth("d") % 5 == 0)
    probe = obs.where((F.dayofmonth("d") % 5).isin(1, 3)).select("series_id", "d")
    return A.asof_tolerance(probe, data, keys=KEY, days=3)


@query("lookback_change_20d", "h_obs", """
    SELECT a.series_id, a.d, o.d AS prior_date, o.v AS prior, round(a.v - o.v, 6) AS change FROM h_obs a
    ASOF LEFT JOIN h_obs o ON a.series_id = o.series_id AND a.d - 20 >= o.d""")
def lookback_change_20d(spark, sf):
    got = A.lookback_change(h_obs(spark, sf), 20, keys=KEY)
    return got.select("series_id", "d", "prior_date", "prior", r6("change", "change"))


@query("lookback_change_fresh", "h_obs", """
    SELECT a.series_id, a.d, CASE WHEN a.d - 20 - o.d <= 1 THEN round(a.v - o.v, 6) END AS change FROM h_obs a
    ASOF LEFT JOIN h_obs o ON a.series_id = o.series_id AND a.d - 20 >= o.d""")
def lookback_change_fresh(spark, sf):
    got = A.lookback_change(h_obs(spark, sf), 20, keys=KEY)
    ok = F.datediff(F.date_sub("d", 20), "prior_date") <= 1
    return got.select("series_id", "d", F.when(ok, F.round("change", 6)).alias("change"))


@query("pct_change_13w", "h_obs", """
    SELECT a.series_id, a.d, round((a.v - o.v) / nullif(o.v, 0), 6) AS growth FROM h_obs a
    ASOF LEFT JOIN h_obs o ON a.series_id = o.series_id AND a.d - 91 >= o.d""")
def pct_change_13w(spark, sf):
    got = A.lookback_change(h_obs(spark, sf), 91, keys=KEY)
    return got.select("series_id", "d", r6(S.safe_div("change", "prior"), "growth"))


@query("multi_series_alignment", "h_obs h_week", """
    SELECT a.d, a.v AS v, b.v AS v2, c.v AS v3, e.v AS v4, f.v AS v5, round(a.v + b.v / c.v + e.v / f.v, 6) AS combined
    FROM (SELECT * FROM h_week WHERE series_id = '1-URGENT') a
    ASOF JOIN (SELECT * FROM h_obs WHERE series_id = '2-HIGH') b ON a.d >= b.d
    ASOF JOIN (SELECT * FROM h_obs WHERE series_id = '3-MEDIUM') c ON a.d >= c.d
    ASOF JOIN (SELECT * FROM h_obs WHERE series_id = '4-NOT SPECIFIED') e ON a.d >= e.d
    ASOF JOIN (SELECT * FROM h_obs WHERE series_id = '5-LOW') f ON a.d >= f.d""")
def multi_series_alignment(spark, sf):
    week, obs = h_week(spark, sf), h_obs(spark, sf)
    pick = lambda df, s: df.where(F.col("series_id") == s).select("d", "v")
    others = {"v2": "2-HIGH", "v3": "3-MEDIUM", "v4": "4-NOT SPECIFIED", "v5": "5-LOW"}
    rows = A.align(pick(week, "1-URGENT"), {k: pick(obs, s) for k, s in others.items()})
    return rows.withColumn("combined", F.round(F.col("v") + F.col("v2") / F.col("v3") + F.col("v4") / F.col("v5"), 6))


@query("shared_dates", "h_obs", """
    SELECT a.d, a.v AS left_v, b.v AS right_v FROM h_obs a JOIN h_obs b ON a.d = b.d
    WHERE a.series_id = '1-URGENT' AND b.series_id = '5-LOW'""")
def shared_dates(spark, sf):
    obs = h_obs(spark, sf)
    a = obs.where("series_id = '1-URGENT'").select("d", F.col("v").alias("left_v"))
    return a.join(obs.where("series_id = '5-LOW'").select("d", F.col("v").alias("right_v")), "d")


@query("splice_series", "h_obs", """
    WITH b AS (SELECT d, v FROM h_obs WHERE series_id = '1-URGENT' AND d < DATE '1999-01-01'),
    m AS (SELECT d, v FROM h_obs WHERE series_id = '2-HIGH'),
    e AS (SELECT max(d) AS ed, arg_max(v, d) AS ev FROM b), k AS (SELECT arg_max(v, d) AS av FROM m, e WHERE d <= ed)
    SELECT d, round(v, 6) AS v FROM b UNION ALL SELECT d, round(ev * v / av, 6) FROM m, e, k WHERE d > ed AND av <> 0""")
def splice_series(spark, sf):
    obs = h_obs(spark, sf)
    base = obs.where("series_id = '1-URGENT' and d < date'1999-01-01'").select("d", "v")
    return A.splice(base, obs.where("series_id = '2-HIGH'").select("d", "v")).select("d", r6("v", "v"))


@query("policy_interval_join", "h_price", """
    WITH p(regime, f, t) AS (VALUES ('A', DATE '1995-06-01', DATE '1997-01-01'), ('B', DATE '1997-01-01', DATE '1999-03-01'), ('C', DATE '1999-03-01', NULL))
    SELECT d, regime, CAST(count(f) OVER (PARTITION BY d) AS BIGINT) AS n_matches FROM h_price LEFT JOIN p ON f <= d AND (t IS NULL OR t > d)""")
def policy_interval_join(spark, sf):
    ranges = spark.createDataFrame(
        [("A", "1995-06-01", "1997-01-01"), ("B", "1997-01-01", "1999-03-01"), ("C", "1999-03-01", None)], "regime string, f string, t string"
    ).select("regime", F.to_date("f").alias("f"), F.to_date("t").alias("t"))
    return A.interval_join(h_price(spark, sf).select("d"), ranges, on="d", start="f", end="t").select("d", "regime", "n_matches")


@query("business_days", "h_obs", """
    WITH g AS (SELECT series_id, lag(d) OVER (PARTITION BY series_id ORDER BY d) AS p, d FROM h_obs)
    SELECT series_id, d, CAST(d - p AS BIGINT) AS calendar_days, CAST(n AS BIGINT) AS weekdays FROM g, LATERAL
        (SELECT count(*) AS n FROM generate_series(1, d - p) t(k) WHERE isodow(p + CAST(k AS INTEGER)) < 6) WHERE p IS NOT NULL""")
def business_days(spark, sf):
    g = h_obs(spark, sf).withColumn("p", N.lag("d", 1, KEY)).where("p is not null")
    return g.select("series_id", "d", F.datediff("d", "p").cast("long").alias("calendar_days"), S.business_days("p", "d").alias("weekdays"))


@query("cadence_daily", "h_obs", """
    WITH g AS (SELECT series_id, d, d - lag(d) OVER (PARTITION BY series_id ORDER BY d) AS gap FROM h_obs)
    SELECT series_id, d, coalesce(bool_and(gap BETWEEN 1 AND 4) OVER w, false) AS ok FROM g
    WINDOW w AS (PARTITION BY series_id ORDER BY d ROWS 8 PRECEDING)""")
def cadence_daily(spark, sf):
    return N.add_cadence(h_obs(spark, sf), "DAILY", 10, KEY, name="ok").select("series_id", "d", "ok")


@query("weekday_anchors", "h_obs", """
    SELECT series_id, CAST(count(*) FILTER (isodow(d) = 3) AS BIGINT) AS wednesdays, CAST(count(*) FILTER (isodow(d) = 5) AS BIGINT) AS fridays,
        CAST(count(DISTINCT date_trunc('week', d)) AS BIGINT) AS weeks FROM h_obs GROUP BY 1""")
def weekday_anchors(spark, sf):
    return h_obs(spark, sf).groupBy("series_id").agg(
        F.count_if(F.weekday("d") == 2).alias("wednesdays"), F.count_if(F.weekday("d") == 4).alias("fridays"), F.count_distinct(S.monday("d")).alias("weeks")
    )


@query("calendar_fridays", "", """
    SELECT CAST(x AS DATE) AS d FROM range(DATE '1995-01-06', DATE '2001-09-01', INTERVAL 7 DAY) t(x)""")
def calendar_fridays(spark, sf):
    return spark.range(1).select(F.explode(F.sequence(F.lit("1995-01-06").cast("date"), F.lit("2001-08-31").cast("date"), F.expr("interval 7 days"))).alias("d"))


# ---------------------------------------------------------------- windows


@query("sma_13", "h_week", """
    SELECT series_id, w, CASE WHEN count(*) OVER x = 13 THEN round(avg(v) OVER x, 6) END AS sma13 FROM h_week
    WINDOW x AS (PARTITION BY series_id ORDER BY w ROWS 12 PRECEDING)""")
def sma_13(spark, sf):
    return h_week(spark, sf).select("series_id", "w", r6(N.sma("v", 13, KEY, "w"), "sma13"))


@query("impulse_and_direction", "h_week", """
    WITH m AS (SELECT series_id, w, v, lag(v, 13) OVER (PARTITION BY series_id ORDER BY w) AS v13,
        CASE WHEN count(*) OVER x = 13 THEN avg(v) OVER x END AS ma FROM h_week WINDOW x AS (PARTITION BY series_id ORDER BY w ROWS 12 PRECEDING))
    SELECT series_id, w, CASE WHEN v - v13 > 50 THEN 'EXPANDING' WHEN v - v13 < -50 THEN 'CONTRACTING' ELSE 'FLAT' END AS impulse,
        CAST(CASE WHEN v - v13 > 50 THEN 80 WHEN v - v13 < -50 THEN 30 ELSE 55 END AS DOUBLE) AS impulse_score,
        CASE WHEN (v - ma) / greatest(1, abs(ma)) > 0.002 THEN 'UP' WHEN (v - ma) / greatest(1, abs(ma)) < -0.002 THEN 'DOWN' ELSE 'FLAT' END AS direction
    FROM m""")
def impulse_and_direction(spark, sf):
    rows = h_week(spark, sf).withColumn("v13", N.lag("v", 13, KEY, "w")).withColumn("ma", N.sma("v", 13, KEY, "w"))
    label = C.impulse_label("v", "v13")
    return rows.select("series_id", "w", label.alias("impulse"), C.impulse_score(label).alias("impulse_score"), C.direction("v", "ma").alias("direction"))


@query("challenger_track", "h_week", """
    WITH i AS (SELECT *, v - lag(v, 1) OVER x AS i1, v - lag(v, 4) OVER x AS i4, v - lag(v, 13) OVER x AS i13,
        CASE WHEN count(*) OVER y = 13 THEN v - avg(v) OVER y END AS gap FROM h_week
        WINDOW x AS (PARTITION BY series_id ORDER BY w), y AS (PARTITION BY series_id ORDER BY w ROWS 12 PRECEDING))
    SELECT series_id, w, round(i1, 6) AS impulse1, round(i4, 6) AS impulse4, round(i13, 6) AS impulse13, round(gap, 6) AS gap,
        round(i4 - lag(i4) OVER (PARTITION BY series_id ORDER BY w), 6) AS acceleration FROM i""")
def challenger_track(spark, sf):
    d = lambda n: F.col("v") - N.lag("v", n, KEY, "w")
    rows = h_week(spark, sf).select("series_id", "w", d(1).alias("i1"), d(4).alias("i4"), d(13).alias("i13"), (F.col("v") - N.sma("v", 13, KEY, "w")).alias("g"))
    return rows.select(
        "series_id", "w", r6("i1", "impulse1"), r6("i4", "impulse4"), r6("i13", "impulse13"), r6("g", "gap"),
        r6(F.col("i4") - N.lag("i4", 1, KEY, "w"), "acceleration"),
    )


MAD = "CASE WHEN len({0}) >= 52 THEN nullif(list_median(list_transform({0}, lambda x: abs(x - list_median({0})))), 0) END"


@query("challenger_score", "h_week", f"""
    WITH i AS (SELECT *, v - lag(v, 4) OVER x AS i4, v - lag(v, 13) OVER x AS i13, CASE WHEN count(*) OVER y = 13 THEN v - avg(v) OVER y END AS gap
        FROM h_week WINDOW x AS (PARTITION BY series_id ORDER BY w), y AS (PARTITION BY series_id ORDER BY w ROWS 12 PRECEDING)),
    p AS (SELECT *, list(gap) FILTER (gap IS NOT NULL) OVER z AS gp, list(i4) FILTER (i4 IS NOT NULL) OVER z AS p4, list(i13) FILTER (i13 IS NOT NULL) OVER z AS p13 FROM i
        WINDOW z AS (PARTITION BY series_id ORDER BY w ROWS BETWEEN 156 PRECEDING AND 1 PRECEDING)),
    m AS (SELECT *, {MAD.format("gp")} AS mg, {MAD.format("p4")} AS m4, {MAD.format("p13")} AS m13 FROM p)
    SELECT series_id, w, round(mg, 6) AS gap_mad, round(100 / (1 + exp(-(0.45 * gap / mg + 0.35 * i4 / m4 + 0.2 * i13 / m13))), 6) AS score FROM m""")
def challenger_score(spark, sf):
    d = lambda n: F.col("v") - N.lag("v", n, KEY, "w")
    rows = h_week(spark, sf).select("series_id", "w", d(4).alias("i4"), d(13).alias("i13"), (F.col("v") - N.sma("v", 13, KEY, "w")).alias("g"))
    rows = rows.select("*", *[N.prior_mad(c, KEY, on="w").alias(f"m_{c}") for c in ("g", "i4", "i13")])
    part = lambda c: F.col(c) / F.col(f"m_{c}")
    return rows.select("series_id", "w", r6("m_g", "gap_mad"), r6(C.logistic_score(part("g"), part("i4"), part("i13")), "score"))


@query("expanding_share", "h_obs", """
    SELECT a.series_id, a.d, round(count(*) FILTER (b.v <= a.v) / count(*), 6) AS share
    FROM h_obs a JOIN h_obs b ON a.series_id = b.series_id AND b.d <= a.d GROUP BY 1, 2""")
def expanding_share(spark, sf):
    return N.expanding_share(h_obs(spark, sf), "v", KEY).select("series_id", "d", r6("share", "share"))


@query("prior_mid_rank", "h_week", """
    SELECT a.series_id, a.w, CASE WHEN count(b.v) >= 52 THEN round((count(*) FILTER (b.v < a.v) + 0.5 * count(*) FILTER (b.v = a.v)) / count(b.v) * 100, 6) END AS pct
    FROM h_week a LEFT JOIN h_week b ON a.series_id = b.series_id AND b.w < a.w GROUP BY 1, 2""")
def prior_mid_rank(spark, sf):
    return N.add_prior_mid_rank(h_week(spark, sf), "v", KEY, 52, "w").select("series_id", "w", r6("rank", "pct"))


@query("average_rank", "h_week", """
    SELECT series_id, w, rank() OVER (PARTITION BY series_id ORDER BY x) + (count(*) OVER (PARTITION BY series_id, x) - 1) / 2 AS avg_rank
    FROM (SELECT series_id, w, round(v / 10000) AS x FROM h_week)""")
def average_rank(spark, sf):
    rows = h_week(spark, sf).select("series_id", "w", F.round(F.col("v") / 10000).alias("x"))
    return rows.select("series_id", "w", N.average_rank("x", KEY).alias("avg_rank"))


@query("hysteresis_verdict", "h_factor", """
    SELECT factor, w, f, coalesce(last_value(CASE WHEN f > 55 THEN 'BULLISH' WHEN f < 45 THEN 'BEARISH' END IGNORE NULLS)
        OVER (PARTITION BY factor ORDER BY w ROWS UNBOUNDED PRECEDING), 'NEUTRAL') AS verdict FROM h_factor""")
def hysteresis_verdict(spark, sf):
    from .harness import h_factor

    return h_factor(spark, sf).select("factor", "w", "f", N.hysteresis(C.band("f"), ["factor"], "w").alias("verdict"))


@query("trailing_week_mean", "h_obs", """
    SELECT series_id, d, round(avg(v) OVER (PARTITION BY series_id ORDER BY d RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), 6) AS mean7 FROM h_obs""")
def trailing_week_mean(spark, sf):
    return h_obs(spark, sf).select("series_id", "d", r6(N.trailing_days_mean("v", 7, KEY), "mean7"))


@query("last_five_as_of", "h_obs h_anchor", """
    WITH l AS (SELECT series_id, d, CASE WHEN count(*) OVER x = 5 THEN avg(v) OVER x END AS m FROM h_obs WINDOW x AS (PARTITION BY series_id ORDER BY d ROWS 4 PRECEDING))
    SELECT a.series_id, a.d, round(l.m, 6) AS mean5 FROM h_anchor a ASOF LEFT JOIN l ON a.series_id = l.series_id AND a.d >= l.d""")
def last_five_as_of(spark, sf):
    rows = h_obs(spark, sf).withColumn("five", N.last_n("v", 5, KEY))
    got = A.asof_last(h_anchor(spark, sf), rows, keys=KEY, carry=["five"])
    mean = F.aggregate("asof_five", F.lit(0.0), lambda a, x: a + x) / 5
    return got.select("series_id", "d", r6(mean, "mean5"))


@query("raw_smooth_weekly", "h_obs", """
    WITH a AS (SELECT d, v FROM h_obs WHERE series_id = '1-URGENT' AND isodow(d) = 3),
    t AS (SELECT d, v, avg(v) OVER (ORDER BY d RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS m FROM h_obs WHERE series_id = '2-HIGH'),
    r AS (SELECT d, v, CASE WHEN count(*) OVER x = 5 THEN avg(v) OVER x END AS m FROM h_obs WHERE series_id = '3-MEDIUM' WINDOW x AS (ORDER BY d ROWS 4 PRECEDING))
    SELECT a.d, a.d + 7 AS available, round(a.v - t.v - r.v, 6) AS raw, round(a.v - t.m - r.m, 6) AS smooth,
        CASE WHEN r.m IS NULL THEN 'MISSING' WHEN a.v - t.m - r.m > 0 THEN 'UP' WHEN a.v - t.m - r.m < 0 THEN 'DOWN' ELSE 'FLAT' END AS smooth_sign
    FROM a JOIN t ON a.d = t.d ASOF JOIN r ON a.d >= r.d""")
def raw_smooth_weekly(spark, sf):
    obs = h_obs(spark, sf)
    pick = lambda s: obs.where(F.col("series_id") == s)
    a = pick("1-URGENT").where(F.weekday("d") == 2).select("d", "v")
    t = pick("2-HIGH").select("d", F.col("v").alias("tv"), N.trailing_days_mean("v", 7, KEY).alias("tm"))
    r = pick("3-MEDIUM").select("d", F.col("v").alias("rv"), N.sma("v", 5, KEY).alias("rm"))
    got = A.asof_last(a.join(t, "d"), r, keys=[], carry=["rv", "rm"], prefix="").where("date is not null")
    raw, smooth = F.col("v") - F.col("tv") - F.col("rv"), F.col("v") - F.col("tm") - F.col("rm")
    return got.select("d", F.date_add("d", 7).alias("available"), r6(raw, "raw"), r6(smooth, "smooth"), C.sign_class(smooth).alias("smooth_sign"))


@query("volatility_target", "h_price", """
    WITH r AS (SELECT d, close / lag(close) OVER (ORDER BY d) - 1 AS ret FROM h_price),
    s AS (SELECT d, count(ret) OVER x AS n, stddev_pop(ret) OVER x AS sd FROM r WINDOW x AS (ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
    SELECT d, CASE WHEN n < 20 THEN NULL WHEN sd = 0 THEN 1.0 ELSE round(least(1, 0.1 / (sd * sqrt(252))), 6) END AS target FROM s""")
def volatility_target(spark, sf):
    rows = h_price(spark, sf).withColumn("ret", F.col("close") / N.lag("close", 1, []) - 1)
    return rows.select("d", r6(N.vol_target("ret", []), "target"))


@query("moving_average_control", "h_price", """
    SELECT d, CASE WHEN count(*) OVER x = 200 AND lag(close) OVER (ORDER BY d) > avg(close) OVER x THEN 1.0 ELSE 0.0 END::DOUBLE AS target
    FROM h_price WINDOW x AS (ORDER BY d ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)""")
def moving_average_control(spark, sf):
    return h_price(spark, sf).select("d", N.ma_control("close", []).alias("target"))


@query("drawdown_path", "h_price", """
    WITH p AS (SELECT d, close, max(close) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS peak FROM h_price),
    s AS (SELECT *, sum(CASE WHEN close >= peak THEN 1 ELSE 0 END) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS k FROM p)
    SELECT d, peak, round(close / peak - 1, 6) AS drawdown, CAST(sum(CASE WHEN close < peak THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY d ROWS UNBOUNDED PRECEDING) AS BIGINT) AS below FROM s""")
def drawdown_path(spark, sf):
    return N.drawdown(h_price(spark, sf), [], value="close").select("d", "peak", r6("drawdown", "drawdown"), "below")


# Live stress, over five steps.
INDEX_STRESS, YIELD_STRESS, DOLLAR_STRESS = -0.04, 0.25, 0.02


@query("live_stress", "h_price h_vix h_rate h_obs", """
    WITH s AS (SELECT d, close / lag(close, 5) OVER (ORDER BY d) - 1 AS move FROM h_price),
    y AS (SELECT d, rate - lag(rate, 5) OVER (ORDER BY d) AS y10 FROM h_rate),
    u AS (SELECT d, v / lag(v, 5) OVER (ORDER BY d) - 1 AS dxy FROM h_obs WHERE series_id = '1-URGENT'),
    j AS (SELECT s.d, s.move, y.y10 FROM s ASOF LEFT JOIN y ON y.d <= s.d),
    k AS (SELECT j.*, u.dxy FROM j ASOF LEFT JOIN u ON u.d <= j.d),
    l AS (SELECT k.*, v.v FROM k ASOF LEFT JOIN h_vix v ON v.d <= k.d)
    SELECT d, round(move, 6) AS move, CASE WHEN v IS NULL OR move IS NULL OR y10 IS NULL OR dxy IS NULL THEN 'UNKNOWN'
        WHEN v > 28 OR move < -0.04 OR y10 > 0.25 OR dxy > 0.02 THEN 'STRESSED' ELSE 'NORMAL' END AS stress FROM l""")
def live_stress(spark, sf):
    """Last VIX, and what the index, the yield and the dollar did over their last five steps; any missing one makes the state unknown."""
    ratio = lambda df, c, name: df.select("d", (F.col(c) / N.lag(c, 5, []) - 1).alias(name))
    rows = ratio(h_price(spark, sf), "close", "move")
    dollar = ratio(h_obs(spark, sf).where("series_id = '1-URGENT'"), "v", "dxy")
    bond = h_rate(spark, sf).select("d", (F.col("rate") - N.lag("rate", 5, [])).alias("y10"))
    for data, c in ((bond, "y10"), (dollar, "dxy"), (h_vix(spark, sf), "v")):
        rows = A.asof_last(rows, data.withColumnRenamed(c, "x"), keys=[], carry=["x"], prefix="").drop("date").withColumnRenamed("x", c)
    missing = F.col("v").isNull() | F.col("move").isNull() | F.col("y10").isNull() | F.col("dxy").isNull()
    strain = (F.col("v") > P.VIX_STRESS) | (F.col("move") < INDEX_STRESS) | (F.col("y10") > YIELD_STRESS) | (F.col("dxy") > DOLLAR_STRESS)
    return rows.select("d", r6("move", "move"), F.when(missing, "UNKNOWN").when(strain, "STRESSED").otherwise("NORMAL").alias("stress"))


# ---------------------------------------------------------------- bitemporal


@query("latest_vintage", "h_pit", """
    SELECT series_id, obs_date, vintage_date, value FROM h_pit
    QUALIFY row_number() OVER (PARTITION BY series_id, obs_date ORDER BY vintage_date DESC) = 1""")
def latest_vintage(spark, sf):
    rows = A.latest_visible(h_pit(spark, sf), ["series_id", "obs_date"], [F.col("vintage_date").desc()], F.lit(True))
    return rows.select("series_id", "obs_date", "vintage_date", "value")


@query("visible_at_cutoff", "h_pit", """
    SELECT series_id, obs_date, vintage_date, value FROM h_pit WHERE released_at < TIMESTAMP '1998-06-30 23:59:59'
    QUALIFY row_number() OVER (PARTITION BY series_id, obs_date ORDER BY vintage_date DESC) = 1""")
def visible_at_cutoff(spark, sf):
    seen = F.col("released_at") < F.lit("1998-06-30 23:59:59").cast("timestamp")
    rows = A.latest_visible(h_pit(spark, sf), ["series_id", "obs_date"], [F.col("vintage_date").desc()], seen)
    return rows.select("series_id", "obs_date", "vintage_date", "value")


@query("vintage_revisions", "h_pit", """
    SELECT series_id, obs_date, vintage_date, value, previous, round(value - previous, 6) AS delta FROM
        (SELECT *, lag(value) OVER (PARTITION BY series_id, obs_date ORDER BY vintage_date) AS previous FROM h_pit) WHERE previous IS NOT NULL""")
def vintage_revisions(spark, sf):
    rows = N.revisions(h_pit(spark, sf), ["series_id", "obs_date"])
    return rows.select("series_id", "obs_date", "vintage_date", "value", "previous", r6("delta", "delta"))


@query("validity_intervals", "h_pit", """
    SELECT series_id, obs_date, vintage_date, released_at, lead(released_at) OVER (PARTITION BY series_id, obs_date ORDER BY released_at, vintage_date) AS valid_to FROM h_pit""")
def validity_intervals(spark, sf):
    rows = A.validity_intervals(h_pit(spark, sf), key=["series_id", "obs_date"])
    return rows.select("series_id", "obs_date", "vintage_date", "released_at", "valid_to")


@query("pit_frames", "h_pit", """
    WITH e AS (SELECT CAST(x AS DATE) AS model_date, CAST(x AS TIMESTAMP) + INTERVAL 86399 SECOND AS decision_at FROM range(DATE '1997-01-01', DATE '1998-01-01', INTERVAL 1 MONTH) t(x)),
    f AS (SELECT e.model_date, p.* FROM e JOIN h_pit p ON p.released_at <= e.decision_at AND p.obs_date <= e.model_date
        QUALIFY row_number() OVER (PARTITION BY e.model_date, p.series_id, p.obs_date ORDER BY p.vintage_date DESC, p.released_at DESC) = 1)
    SELECT model_date, series_id, CAST(count(*) AS BIGINT) AS n, max(obs_date) AS last_obs, arg_max(value, obs_date) AS last_value,
        max(released_at) AS data_cutoff, round(sum(value), 2) AS total FROM f GROUP BY 1, 2""")
def pit_frames(spark, sf):
    dates = F.explode(F.sequence(F.lit("1997-01-01").cast("date"), F.lit("1997-12-01").cast("date"), F.expr("interval 1 month")))
    events = spark.range(1).select(dates.alias("model_date")).withColumn("decision_at", S.at_time("model_date", "23:59:59"))
    rows = A.bitemporal_frames(h_pit(spark, sf), events, key=["series_id", "obs_date"])
    return rows.groupBy("model_date", "series_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("obs_date").alias("last_obs"), F.max_by("value", "obs_date").alias("last_value"),
        F.max("released_at").alias("data_cutoff"), F.round(F.sum("value"), 2).alias("total"),
    )


@query("first_vintage_events", "h_pit", """
    SELECT obs_date AS model_date, vintage_date, released_at AS decision_at FROM h_pit WHERE series_id = '1-URGENT' AND released_at <= TIMESTAMP '2000-01-01'
    QUALIFY row_number() OVER (PARTITION BY obs_date ORDER BY vintage_date, released_at) = 1""")
def first_vintage_events(spark, sf):
    seen = (F.col("series_id") == "1-URGENT") & (F.col("released_at") <= F.lit("2000-01-01").cast("timestamp"))
    rows = A.latest_visible(h_pit(spark, sf), ["obs_date"], [F.col("vintage_date"), F.col("released_at")], seen)
    return rows.select(F.col("obs_date").alias("model_date"), "vintage_date", F.col("released_at").alias("decision_at"))


@query("override_join", "h_pit", """
    WITH o AS (SELECT series_id, vintage_date, min(released_at) - INTERVAL 3 HOUR AS rel, CAST(vintage_date AS TIMESTAMP) + INTERVAL 9 HOUR AS created FROM h_pit WHERE day(vintage_date) % 7 = 0 GROUP BY 1, 2
        UNION ALL SELECT series_id, vintage_date, min(released_at) - INTERVAL 1 HOUR, CAST(vintage_date AS TIMESTAMP) + INTERVAL 30 DAY FROM h_pit WHERE day(vintage_date) % 14 = 0 GROUP BY 1, 2),
    l AS (SELECT * FROM o WHERE created <= TIMESTAMP '1998-12-31' QUALIFY row_number() OVER (PARTITION BY series_id, vintage_date ORDER BY created DESC) = 1)
    SELECT p.series_id, p.obs_date, p.vintage_date, coalesce(l.rel, p.released_at) AS released_at, l.rel IS NOT NULL AS overridden FROM h_pit p LEFT JOIN l USING (series_id, vintage_date)""")
def override_join(spark, sf):
    pit = h_pit(spark, sf)
    days = pit.groupBy("series_id", "vintage_date").agg(F.min("released_at").alias("r"))
    start = F.col("vintage_date").cast("timestamp")
    shift = lambda c, secs: (c.cast("long") + secs).cast("timestamp")
    o = days.where(F.dayofmonth("vintage_date") % 7 == 0).select("series_id", "vintage_date", shift(F.col("r"), -10800).alias("rel"), shift(start, 32400).alias("created"))
    o2 = days.where(F.dayofmonth("vintage_date") % 14 == 0).select("series_id", "vintage_date", shift(F.col("r"), -3600).alias("rel"), shift(start, 30 * 86400).alias("created"))
    last = A.latest_visible(o.unionByName(o2), ["series_id", "vintage_date"], [F.col("created").desc()], F.col("created") <= F.lit("1998-12-31").cast("timestamp"))
    got = pit.join(last.select("series_id", "vintage_date", "rel"), ["series_id", "vintage_date"], "left")
    return got.select("series_id", "obs_date", "vintage_date", F.coalesce("rel", "released_at").alias("released_at"), F.col("rel").isNotNull().alias("overridden"))


@query("prefix_maxima", "h_pit", """
    SELECT series_id, obs_date, vintage_date, max(released_at) OVER (PARTITION BY series_id ORDER BY obs_date, vintage_date ROWS UNBOUNDED PRECEDING) AS cutoff FROM h_pit""")
def prefix_maxima(spark, sf):
    w = W.partitionBy("series_id").orderBy("obs_date", "vintage_date").rowsBetween(W.unboundedPreceding, 0)
    return h_pit(spark, sf).select("series_id", "obs_date", "vintage_date", F.max("released_at").over(w).alias("cutoff"))


@query("vintage_conflicts", "h_pit", """
    SELECT series_id, obs_date, CAST(count(DISTINCT value) AS BIGINT) AS n_values FROM h_pit GROUP BY 1, 2 HAVING count(DISTINCT value) > 1""")
def vintage_conflicts(spark, sf):
    return T.conflicts(h_pit(spark, sf), ["series_id", "obs_date"], "value")


@query("upsert_last_write", "h_obs", """
    SELECT series_id, d, round(CASE WHEN day(d) % 3 = 0 THEN v * 2 ELSE v END, 6) AS v FROM h_obs""")
def upsert_last_write(spark, sf):
    obs = h_obs(spark, sf)
    new = obs.where(F.dayofmonth("d") % 3 == 0).withColumn("v", F.col("v") * 2)
    return T.upsert(obs, new, ["series_id", "d"], ["v"]).select("series_id", "d", r6("v", "v"))


@query("append_first_write", "h_obs", """
    SELECT series_id, d, round(CASE WHEN day(d) % 2 = 0 THEN v ELSE v + 1 END, 6) AS v FROM h_obs""")
def append_first_write(spark, sf):
    obs = h_obs(spark, sf)
    new = obs.withColumn("v", F.col("v") + 1)
    return T.append_new(obs.where(F.dayofmonth("d") % 2 == 0), new, ["series_id", "d"]).select("series_id", "d", r6("v", "v"))


@query("changed_revisions", "h_pit", """
    WITH l AS (SELECT * FROM h_pit QUALIFY row_number() OVER (PARTITION BY series_id, obs_date ORDER BY vintage_date DESC) = 1)
    SELECT series_id, obs_date, value + 1 AS value FROM l WHERE day(obs_date) % 4 = 1""")
def changed_revisions(spark, sf):
    pit = h_pit(spark, sf)
    last = A.latest_visible(pit, ["series_id", "obs_date"], [F.col("vintage_date").desc()], F.lit(True))
    new = last.withColumn("value", F.when(F.dayofmonth("obs_date") % 4 == 1, F.col("value") + 1).otherwise(F.col("value")))
    return T.changed_revisions(pit, new, ["series_id", "obs_date"], "vintage_date", ["value"]).select("series_id", "obs_date", "value")


@query("one_row_per_week", "h_obs", """
    SELECT series_id, CAST(date_trunc('week', d) AS DATE) AS week, max(d) AS d, arg_max(v, d) AS v FROM h_obs GROUP BY 1, 2""")
def one_row_per_week(spark, sf):
    return T.per_week(h_obs(spark, sf), KEY).select("series_id", "week", "d", "v")


@query("latest_turn", "", """
    SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""")
def latest_turn(spark, sf):
    rows = A.latest_visible(table(spark, sf, "conversations"), ["conv_id"], [F.col("turn").desc()], F.lit(True))
    return rows.select("conv_id", "turn", "role")


@query("revision_lineage", "", """
    SELECT conv_id, turn, prev IS NOT NULL AND prev = turn - 1 OR turn = 0 AS linked FROM
        (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)""")
def revision_lineage(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("prev", F.lag("turn").over(W.partitionBy("conv_id").orderBy("turn")))
    linked = F.coalesce(F.col("prev") == F.col("turn") - 1, F.lit(False)) | (F.col("turn") == 0)
    return rows.select("conv_id", "turn", linked.alias("linked"))


@query("cash_rate_strictly_before", "h_price h_rate", """
    WITH s AS (SELECT d, lag(d) OVER (ORDER BY d) AS p FROM h_price)
    SELECT s.d, r.rate, CASE WHEN s.p IS NULL THEN 'FIRST' WHEN r.d IS NULL THEN 'MISSING' WHEN s.p - r.d > 4 THEN 'STALE' ELSE 'OK' END AS status
    FROM s ASOF LEFT JOIN h_rate r ON s.p > r.d""")
def cash_rate_strictly_before(spark, sf):
    s = h_price(spark, sf).select("d", N.lag("d", 1, []).alias("p"))
    got = A.asof_last(s, h_rate(spark, sf), keys=[], on="p", data_on="d", carry=["rate"], prefix="r_", strict=True)
    status = F.when(F.col("p").isNull(), "FIRST").when(F.col("r_date").isNull(), "MISSING").when(F.datediff("p", "r_date") > 4, "STALE").otherwise("OK")
    return got.select("d", F.col("r_rate").alias("rate"), status.alias("status"))
