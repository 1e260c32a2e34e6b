"""Queries: policy, guidance, dual horizon, reserve features, studies, validators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from ..functions import scores as C
from ..operators import asof as A
from ..operators import simulate as M
from ..operators import stats as X
from ..operators import windows as N
from .evaluation import SPEARMAN
from .harness import h_factor, h_obs, h_pairs, h_pit, h_price, h_signal, h_week, query, r6, table

SIX = ["QE", "QT", "RESERVE_MANAGEMENT", "REINVESTMENT_ONLY", "NEUTRAL", "CRISIS_LIQUIDITY", "UNKNOWN"]
IMPULSE = "CASE WHEN v - lag(v, 13) OVER x > 50 THEN 'EXPANDING' WHEN v - lag(v, 13) OVER x < -50 THEN 'CONTRACTING' ELSE 'FLAT' END"


@query("policy_aware_score", "h_week", f"""
    WITH m(regime, e, f, c) AS (VALUES ('QE', 80.0::DOUBLE, 60.0::DOUBLE, 40.0::DOUBLE), ('QT', 50, 40, 30), ('RESERVE_MANAGEMENT', 57.5, 52.5, 42.5), ('REINVESTMENT_ONLY', 52.5, 50, 45), ('NEUTRAL', 55, 50, 45)),
    i AS (SELECT w, {IMPULSE} AS impulse, ['QE', 'QT', 'RESERVE_MANAGEMENT', 'REINVESTMENT_ONLY', 'NEUTRAL', 'CRISIS_LIQUIDITY', 'UNKNOWN'][1 + year(w) % 7] AS regime FROM h_week WHERE series_id = '1-URGENT' WINDOW x AS (ORDER BY w))
    SELECT w, i.regime, impulse, CASE WHEN i.regime = 'CRISIS_LIQUIDITY' THEN 'CRISIS_POLICY_SEPARATE' WHEN m.regime IS NULL THEN 'POLICY_UNAVAILABLE' ELSE 'OK' END AS status,
        CASE impulse WHEN 'EXPANDING' THEN e WHEN 'FLAT' THEN f ELSE c END AS score FROM i LEFT JOIN m ON i.regime = m.regime""")
def policy_aware_score(spark, sf):
    rows = h_week(spark, sf).where("series_id = '1-URGENT'")
    regime = F.element_at(F.array(*[F.lit(x) for x in SIX]), F.year("w") % 7 + 1)
    rows = rows.select("w", regime.alias("regime"), C.impulse_label("v", N.lag("v", 13, [], "w")).alias("impulse"))
    return rows.withColumn("s", C.policy_score("regime", "impulse")).select("w", "regime", "impulse", "s.status", "s.score")


@query("policy_label", "h_week", f"""
    SELECT w, CASE WHEN w >= DATE '2025-12-01' THEN 'RESERVE_MGMT' WHEN impulse = 'EXPANDING' THEN 'QE' WHEN impulse = 'CONTRACTING' THEN 'QT' ELSE 'NEUTRAL' END AS label
    FROM (SELECT w, {IMPULSE} AS impulse FROM h_week WHERE series_id = '1-URGENT' WINDOW x AS (ORDER BY w))""")
def policy_label(spark, sf):
    rows = h_week(spark, sf).where("series_id = '1-URGENT'")
    return rows.select("w", C.policy_label("w", C.impulse_label("v", N.lag("v", 13, [], "w"))).alias("label"))


@query("guidance", "h_signal", """
    WITH s AS (SELECT idx, score, verdict, CASE WHEN idx % 11 = 0 THEN 'UNKNOWN' WHEN idx % 3 = 0 THEN 'STRESSED' ELSE 'NORMAL' END AS stress, CASE WHEN idx % 2 = 0 THEN 'UP' ELSE 'DOWN' END AS dir,
        CASE idx % 5 WHEN 0 THEN 'EXPANDING' WHEN 1 THEN 'CONTRACTING' ELSE 'FLAT' END AS impulse FROM h_signal)
    SELECT idx, CASE WHEN stress = 'UNKNOWN' THEN 'unknown' WHEN stress = 'STRESSED' AND score < 65 THEN 'brake' WHEN verdict = 'BULLISH' AND dir = 'DOWN' THEN 'neutral' WHEN verdict = 'BULLISH' THEN 'bull' WHEN verdict = 'BEARISH' THEN 'bear' ELSE 'neutral' END AS tone,
        CASE WHEN impulse = 'EXPANDING' AND dir = 'DOWN' THEN 'EXPANDING_BUT_DRAINING' WHEN impulse = 'CONTRACTING' AND dir = 'UP' THEN 'CONTRACTING_BUT_ADDING' END AS divergence,
        score < 45 OR score - 45 <= 2 AS armed FROM s""")
def guidance(spark, sf):
    i = F.col("idx")
    stress = F.when(i % 11 == 0, "UNKNOWN").when(i % 3 == 0, "STRESSED").otherwise("NORMAL")
    dir_ = F.when(i % 2 == 0, "UP").otherwise("DOWN")
    impulse = F.when(i % 5 == 0, "EXPANDING").when(i % 5 == 1, "CONTRACTING").otherwise("FLAT")
    return h_signal(spark, sf).select("idx", C.guidance_tone("verdict", dir_, "score", stress).alias("tone"), C.divergence(impulse, dir_).alias("divergence"), C.bear_trigger_armed("score").alias("armed"))


@query("benchmark_scores", "h_factor", """
    WITH t(factor, wt) AS (VALUES ('1-URGENT', 0.35), ('2-HIGH', 0.18), ('3-MEDIUM', 0.15), ('4-NOT SPECIFIED', 0.06), ('5-LOW', 0.04)),
    a AS (SELECT w, count(*) AS n, avg(f) AS e, sum(f * wt) / sum(wt) AS c FROM h_factor JOIN t USING (factor) GROUP BY 1)
    SELECT w, CASE WHEN n = 5 THEN 'OK' ELSE 'INCOMPLETE_FACTOR_COHORT' END AS status, CASE WHEN n = 5 THEN round(e, 6) END AS equal_score, CASE WHEN n = 5 THEN round(c, 6) END AS current_score, CASE WHEN n = 5 THEN round((e + c) / 2, 6) END AS blend_score FROM a""")
def benchmark_scores(spark, sf):
    weights = F.broadcast(spark.createDataFrame([("1-URGENT", 0.35), ("2-HIGH", 0.18), ("3-MEDIUM", 0.15), ("4-NOT SPECIFIED", 0.06), ("5-LOW", 0.04)], "factor string, wt double"))
    ok = F.count(F.lit(1)) == 5
    e, c = F.avg("f"), F.sum(F.col("f") * F.col("wt")) / F.sum("wt")
    return h_factor(spark, sf).join(weights, "factor").groupBy("w").agg(
        F.when(ok, "OK").otherwise("INCOMPLETE_FACTOR_COHORT").alias("status"), F.when(ok, F.round(e, 6)).alias("equal_score"),
        F.when(ok, F.round(c, 6)).alias("current_score"), F.when(ok, F.round((e + c) / 2, 6)).alias("blend_score"),
    )


@query("dual_horizon_confidence", "h_factor", """
    WITH m AS (SELECT w, count(*) FILTER (factor < '5' AND f > 55) AS up, count(*) FILTER (factor < '5' AND f < 45) AS down, count(*) AS n FROM h_factor GROUP BY 1 HAVING count(*) FILTER (factor < '5') = 4),
    c AS (SELECT w, up, down, n, row_number() OVER (ORDER BY w) AS k, CASE WHEN up > down THEN 'HIGH' WHEN up < down THEN 'LOW' ELSE 'TRANSITION' END AS rs FROM m)
    SELECT w, round(100 * greatest(up + 0.5 * (4 - up - down), down + 0.5 * (4 - up - down)) / 4, 6)::DOUBLE AS agreement,
        round((n / 5 * 100 + 75 + least(100, k / 52 * 100) + 100 * greatest(up + 0.5 * (4 - up - down), down + 0.5 * (4 - up - down)) / 4 + CASE rs WHEN 'HIGH' THEN 100 WHEN 'LOW' THEN 0 ELSE 50 END) / 5, 6)::DOUBLE AS confidence FROM c""")
def dual_horizon_confidence(spark, sf):
    major = F.col("factor") < "5"
    m = h_factor(spark, sf).groupBy("w").agg(
        F.count_if(major & (F.col("f") > 55)).alias("up"), F.count_if(major & (F.col("f") < 45)).alias("down"), F.count(F.lit(1)).alias("n"), F.count_if(major).alias("k4")
    )
    m = m.where("k4 = 4").withColumn("k", F.row_number().over(W.orderBy("w")))
    rs = F.when(F.col("up") > F.col("down"), "HIGH").when(F.col("up") < F.col("down"), "LOW").otherwise("TRANSITION")
    agree = C.factor_agreement("up", "down")
    return m.select("w", r6(agree, "agreement"), r6(C.confidence(F.col("n") / 5 * 100, F.lit(75.0), "k", agree, rs), "confidence"))


@query("reserve_weekly_features", "h_obs", """
    WITH f AS (SELECT CAST(x AS DATE) AS a FROM range(DATE '1996-01-05', DATE '2001-06-30', INTERVAL 7 DAY) t(x)),
    p AS (SELECT s.d, (s.v - i.v) / 1000 * 100 AS spread FROM h_obs s JOIN h_obs i ON s.d = i.d WHERE s.series_id = '4-NOT SPECIFIED' AND i.series_id = '5-LOW'),
    q AS (SELECT f.a, count(p.d) AS n, max(p.d) AS last, quantile_cont(spread, 0.5) AS med, quantile_cont(spread, 0.95) AS p95 FROM f LEFT JOIN p ON p.d BETWEEN f.a - 6 AND f.a GROUP BY 1)
    SELECT q.a AS anchor, CASE WHEN n < 3 THEN 'MISSING' WHEN q.a - last > 4 THEN 'STALE' ELSE 'OK' END AS status, CASE WHEN n >= 3 AND q.a - last <= 4 THEN round(med, 1) END AS median_bp,
        CASE WHEN n >= 3 AND q.a - last <= 4 THEN round(p95, 1) END AS p95_bp, round(r.v / g.v * 100, 6) AS relative, round(r.v - o.v, 6) AS change13
    FROM q ASOF LEFT JOIN (SELECT d, v FROM h_obs WHERE series_id = '1-URGENT') r ON q.a >= r.d
    ASOF LEFT JOIN (SELECT d, v FROM h_obs WHERE series_id = '2-HIGH') g ON q.a >= g.d
    ASOF LEFT JOIN (SELECT d, v FROM h_obs WHERE series_id = '1-URGENT') o ON r.d - 91 >= o.d""")
def reserve_weekly_features(spark, sf):
    obs = h_obs(spark, sf)
    pick = lambda s, n: obs.where(F.col("series_id") == s).select("d", F.col("v").alias(n))
    fridays = F.explode(F.sequence(F.lit("1996-01-05").cast("date"), F.lit("2001-06-29").cast("date"), F.expr("interval 7 days")))
    f = spark.range(1).select(fridays.alias("a"))
    pairs = pick("4-NOT SPECIFIED", "s").join(pick("5-LOW", "i"), "d").select("d", ((F.col("s") - F.col("i")) / 1000 * 100).alias("spread"))
    # a day belongs to the one Friday week that ends at or after it
    pairs = pairs.withColumn("a", F.next_day(F.date_sub("d", 1), "FRI"))
    q = f.join(pairs, "a", "left").groupBy("a").agg(F.count("d").alias("n"), F.max("d").alias("last"), F.expr("percentile(spread, 0.5D)").alias("med"), F.expr("percentile(spread, 0.95D)").alias("p95"))
    q = A.asof_last(q, pick("1-URGENT", "r"), keys=[], on="a", data_on="d", carry=["r"], prefix="r_")
    q = A.asof_last(q, pick("2-HIGH", "g"), keys=[], on="a", data_on="d", carry=["g"], prefix="g_")
    q = A.asof_last(q.withColumn("then", F.date_sub("r_date", 91)), pick("1-URGENT", "o"), keys=[], on="then", data_on="d", carry=["o"], prefix="o_")
    status = F.when(F.col("n") < 3, "MISSING").when(F.datediff("a", "last") > 4, "STALE").otherwise("OK")
    ok = lambda c: F.when(status == "OK", F.round(c, 1))
    return q.select(
        F.col("a").alias("anchor"), status.alias("status"), ok("med").alias("median_bp"), ok("p95").alias("p95_bp"),
        r6(F.col("r_r") / F.col("g_g") * 100, "relative"), r6(F.col("r_r") - F.col("o_o"), "change13"),
    )


@query("reserve_weekly_score", "h_week", """
    WITH p AS (SELECT a.series_id, a.w, CASE WHEN count(b.v) >= 52 THEN (count(*) FILTER (b.v < a.v) + 0.5 * count(*) FILTER (b.v = a.v)) / count(b.v) * 100 END AS p FROM h_week a LEFT JOIN h_week b ON a.series_id = b.series_id AND b.w < a.w GROUP BY 1, 2),
    v AS (SELECT w, max(p) FILTER (series_id = '1-URGENT') AS a, max(p) FILTER (series_id = '2-HIGH') AS b, max(p) FILTER (series_id = '3-MEDIUM') AS c, max(p) FILTER (series_id = '5-LOW') AS d FROM p GROUP BY 1)
    SELECT w, round(0.3 * a + 0.25 * b + 0.25 * (100 - c) + 0.2 * (100 - d), 6) AS score FROM v""")
def reserve_weekly_score(spark, sf):
    rows = N.add_prior_mid_rank(h_week(spark, sf), "v", ["series_id"], 52, "w", "p")
    of = lambda s: F.max(F.when(F.col("series_id") == s, F.col("p")))
    v = rows.groupBy("w").agg(of("1-URGENT").alias("a"), of("2-HIGH").alias("b"), of("3-MEDIUM").alias("c"), of("5-LOW").alias("d"))
    score = F.col("a") * 0.3 + F.col("b") * 0.25 + (F.lit(100.0) - F.col("c")) * 0.25 + (F.lit(100.0) - F.col("d")) * 0.2
    return v.select("w", r6(score, "score"))


@query("benchmark_targets", "h_price", """
    WITH r AS (SELECT d, close, close / lag(close) OVER (ORDER BY d) - 1 AS ret FROM h_price),
    s AS (SELECT d, close, count(ret) OVER x AS n, stddev_pop(ret) OVER x AS sd, count(*) OVER y AS m, avg(close) OVER y AS ma, lag(close) OVER (ORDER BY d) AS pc FROM r
        WINDOW x AS (ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), y AS (ORDER BY d ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING))
    SELECT methodology, CAST(count(*) AS BIGINT) AS n, round(avg(target), 6) AS mean_target FROM (
        SELECT 'buy_hold' AS methodology, 1.0::DOUBLE AS target FROM s UNION ALL SELECT 'static', 0.6 FROM s
        UNION ALL SELECT 'vol_target', CASE WHEN n < 20 THEN NULL WHEN sd = 0 THEN 1 ELSE least(1, 0.1 / (sd * sqrt(252))) END FROM s
        UNION ALL SELECT 'moving_average', CASE WHEN m = 200 AND pc > ma THEN 1 ELSE 0 END FROM s) GROUP BY 1""")
def benchmark_targets(spark, sf):
    rows = h_price(spark, sf).withColumn("ret", F.col("close") / N.lag("close", 1, []) - 1)
    targets = {"buy_hold": F.lit(1.0), "static": F.lit(0.6), "vol_target": N.vol_target("ret", []), "moving_average": N.ma_control("close", [])}
    rows = rows.select(*[v.alias(k) for k, v in targets.items()])
    stacked = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("methodology"), F.col(k).alias("target")) for k in targets])).alias("x"))
    return stacked.groupBy("x.methodology").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("x.target"), "mean_target"))


@query("fold_table", "h_pairs", """
    WITH f(fold, a, b) AS (VALUES (1, DATE '1997-01-01', DATE '1998-01-01'), (2, DATE '1998-01-01', DATE '1999-01-01'), (3, DATE '1999-01-01', DATE '2000-01-01'), (4, DATE '2010-01-01', DATE '2011-01-01'))
    SELECT fold, CAST(count(*) FILTER (outcome_d <= a) AS BIGINT) AS n_train, CAST(count(*) FILTER (d >= a AND d < b) AS BIGINT) AS n_test, round(avg(fwd) FILTER (d >= a AND d < b), 6) AS mean_fwd FROM f CROSS JOIN h_pairs GROUP BY 1""")
def fold_table(spark, sf):
    folds = spark.createDataFrame([(1, "1997-01-01", "1998-01-01"), (2, "1998-01-01", "1999-01-01"), (3, "1999-01-01", "2000-01-01"), (4, "2010-01-01", "2011-01-01")], "fold int, a string, b string")
    folds = F.broadcast(folds.select("fold", F.to_date("a").alias("a"), F.to_date("b").alias("b")))
    inside = (F.col("d") >= F.col("a")) & (F.col("d") < F.col("b"))
    return h_pairs(spark, sf).crossJoin(folds).groupBy("fold").agg(F.count_if(F.col("outcome_d") <= F.col("a")).alias("n_train"), F.count_if(inside).alias("n_test"), r6(F.avg(F.when(inside, F.col("fwd"))), "mean_fwd"))


@query("frozen_holdout", "h_pairs", """
    SELECT CASE WHEN count(*) >= 5 THEN 'OK' ELSE 'PENDING_MATURITY' END AS status, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN (score >= 50) = (fwd >= 0) THEN 1.0 ELSE 0 END), 6)::DOUBLE AS hit_rate FROM h_pairs WHERE d >= DATE '2000-06-01'""")
def frozen_holdout(spark, sf):
    n = F.count(F.lit(1))
    return h_pairs(spark, sf).where("d >= date'2000-06-01'").agg(F.when(n >= 5, "OK").otherwise("PENDING_MATURITY").alias("status"), n.alias("n"), r6(X.hit_rate("score", "fwd"), "hit_rate"))


@query("disagreement_summary", "h_pairs", """
    SELECT CAST(count(*) AS BIGINT) AS n, round(avg(fwd), 6) AS mean, round(median(fwd), 6) AS median, round(avg(CASE WHEN fwd < 0 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS p_negative FROM h_pairs WHERE (verdict = 'BULLISH') <> (target_exposure > 0.6)""")
def disagreement_summary(spark, sf):
    apart = (F.col("verdict") == "BULLISH") != (F.col("target_exposure") > 0.6)
    return h_pairs(spark, sf).where(apart).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("fwd"), "mean"), r6(F.median("fwd"), "median"), r6(F.avg((F.col("fwd") < 0).cast("double")), "p_negative"))


@query("monotonicity", "h_pairs", """
    WITH q AS (SELECT fwd, CAST(ceil(5.0 * row_number() OVER (ORDER BY score, d) / count(*) OVER ()) AS BIGINT) AS quintile FROM h_pairs), m AS (SELECT quintile, avg(fwd) AS a FROM q GROUP BY 1)
    SELECT CAST(count(*) FILTER (a < p) AS BIGINT) AS violations, round(max(a) FILTER (quintile = 5) - max(a) FILTER (quintile = 1), 6) AS spread FROM (SELECT *, lag(a) OVER (ORDER BY quintile) AS p FROM m)""")
def monotonicity(spark, sf):
    m = X.quintile(h_pairs(spark, sf), ["score", "d"], []).groupBy("quintile").agg(F.avg("fwd").alias("a"))
    m = m.withColumn("p", F.lag("a").over(W.orderBy("quintile")))
    at = lambda k: F.max(F.when(F.col("quintile") == k, F.col("a")))
    return m.agg(F.count_if(F.col("a") < F.col("p")).alias("violations"), r6(at(5) - at(1), "spread"))


@query("stride_independent", "h_signal h_price", """
    WITH RECURSIVE s AS (SELECT idx AS i, s.d, score, p.close FROM h_signal s JOIN h_price p USING (d)),
    n AS (SELECT a.*, (SELECT min(b.i) FROM s b WHERE b.d >= a.d + 91 AND b.i > a.i) AS j FROM s a),
    g AS (SELECT * FROM n WHERE i = 1 UNION ALL SELECT n.* FROM g JOIN n ON n.i = g.j)
    SELECT g.d, e.d AS outcome_d, g.score, round(e.close / g.close - 1, 6) AS fwd FROM g JOIN s e ON e.i = g.j WHERE e.d - g.d <= 105""")
def stride_independent(spark, sf):
    from ..operators.sets import chronological_set

    rows = h_signal(spark, sf).select("d", "score").join(h_price(spark, sf), "d")
    nxt = A.asof_first(rows.withColumn("t", F.date_add("d", 91)), rows.select("d", "close"), keys=[], on="t", data_on="d", carry=["close"], prefix="e_").where("e_date is not null")
    kept = chronological_set(nxt, [], "d", "e_date").where(F.datediff("e_date", "d") <= 105)
    return kept.select("d", F.col("e_date").alias("outcome_d"), "score", r6(F.col("e_close") / F.col("close") - 1, "fwd"))


@query("best_lead", "h_week h_price", """
    WITH g AS (SELECT a.w, a.v / nullif(b.v, 0) - 1 AS growth FROM h_week a JOIN h_week b ON b.series_id = a.series_id AND b.w = a.w - 91 WHERE a.series_id = '1-URGENT'),
    p AS (SELECT lead, g.growth, y.close / x.close - 1 AS fwd FROM (SELECT * FROM g CROSS JOIN (SELECT i AS lead FROM range(0, 27, 2) t(i))) g
        ASOF JOIN h_price x ON x.d <= g.w + CAST(7 * lead AS INTEGER) ASOF JOIN h_price y ON y.d <= g.w + CAST(7 * lead AS INTEGER) + 91
        WHERE g.w + CAST(7 * lead AS INTEGER) + 91 <= (SELECT max(d) FROM h_price)),
    s AS (""" + SPEARMAN.format(k="lead", x="growth", y="fwd", t="p", empty="0") + ") SELECT lead, ic FROM s ORDER BY ic DESC, lead LIMIT 1")
def best_lead(spark, sf):
    """The arg-max over leads; the limit is the feature."""
    from .evaluation import lead_scan

    return lead_scan(spark, sf).orderBy(F.col("ic").desc(), "lead").limit(1).select("lead", "ic")


@query("global_composition", "h_week h_obs", """
    WITH c AS (SELECT a.d, a.v AS fed, b.v * 0.5 AS ecb, e.v / f.v * 1000 AS boj FROM (SELECT * FROM h_week WHERE series_id = '1-URGENT') a
        ASOF JOIN (SELECT * FROM h_obs WHERE series_id = '2-HIGH') b ON a.d >= b.d ASOF JOIN (SELECT * FROM h_obs WHERE series_id = '4-NOT SPECIFIED') e ON a.d >= e.d ASOF JOIN (SELECT * FROM h_obs WHERE series_id = '5-LOW' AND v <> 0) f ON a.d >= f.d),
    g AS (SELECT *, fed + ecb + boj AS gl FROM c), p AS (SELECT g.*, (g.gl - o.gl) / o.gl * 100 AS trend FROM g ASOF LEFT JOIN g o ON g.d - 91 >= o.d)
    SELECT d, round(fed / gl, 6) AS fed_share, round(trend, 6) AS trend_pct, CASE WHEN trend > 0.5 THEN 'UP' WHEN trend < -0.5 THEN 'DOWN' ELSE 'FLAT' END AS dir FROM p""")
def global_composition(spark, sf):
    week, obs = h_week(spark, sf), h_obs(spark, sf)
    pick = lambda df, s: df.where(F.col("series_id") == s).select("d", "v")
    c = A.align(pick(week, "1-URGENT"), {"b": pick(obs, "2-HIGH"), "e": pick(obs, "4-NOT SPECIFIED"), "f": pick(obs, "5-LOW").where("v <> 0")})
    g = c.select("d", F.col("v").alias("fed"), (F.col("v") + F.col("b") * 0.5 + F.col("e") / F.col("f") * 1000).alias("gl"))
    got = A.asof_last(g.withColumn("t", F.date_sub("d", 91)), g, keys=[], on="t", data_on="d", carry=["gl"], prefix="o_").withColumn("x", (F.col("gl") - F.col("o_gl")) / F.col("o_gl") * 100)
    return got.select("d", r6(F.col("fed") / F.col("gl"), "fed_share"), r6("x", "trend_pct"), F.when(F.col("x") > 0.5, "UP").when(F.col("x") < -0.5, "DOWN").otherwise("FLAT").alias("dir"))


@query("release_timing", "h_pit", """
    WITH f AS (SELECT *, CAST(vintage_date + CAST(day(obs_date) % 2 AS INTEGER) AS TIMESTAMP) + INTERVAL 18 HOUR AS fetched FROM h_pit),
    r AS (SELECT *, CASE WHEN CAST(fetched AS DATE) = vintage_date THEN fetched ELSE CAST(vintage_date AS TIMESTAMP) + INTERVAL 86399 SECOND END AS rel FROM f)
    SELECT series_id, obs_date, vintage_date, rel AS released_at, CASE WHEN CAST(fetched AS DATE) = vintage_date THEN 'OBSERVED_AT_FETCH' ELSE 'CONSERVATIVE_DATE_END' END AS status,
        CAST(CAST(rel AS DATE) + (CASE isodow(CAST(rel AS DATE)) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END)::INTEGER AS TIMESTAMP) + INTERVAL 52200 SECOND AS tradable_at FROM r""")
def release_timing(spark, sf):
    fetched = S.at_time(F.date_add("vintage_date", F.dayofmonth("obs_date") % 2), "18:00:00")
    rows = h_pit(spark, sf).withColumn("fetched", fetched).withColumn("r", S.release_timing("vintage_date", "fetched", F.lit("23:59:59")))
    return rows.select("series_id", "obs_date", "vintage_date", "r.released_at", "r.status", "r.tradable_at")


@query("execution_availability", "h_pit h_signal", """
    SELECT s.idx, CAST(count(p.value) AS BIGINT) AS n FROM h_signal s LEFT JOIN (SELECT * FROM h_pit WHERE series_id = '1-URGENT' AND year(obs_date) = 1997) p
        ON p.released_at <= s.decision_at AND p.released_at + INTERVAL 15 HOUR <= s.tradable_at AND p.obs_date > s.d - 10 WHERE year(s.d) = 1997 GROUP BY 1""")
def execution_availability(spark, sf):
    p = h_pit(spark, sf).where("series_id = '1-URGENT' and year(obs_date) = 1997")
    s = h_signal(spark, sf).where("year(d) = 1997")
    seen = (F.col("released_at") <= F.col("decision_at")) & (F.col("released_at") + F.expr("interval 15 hours") <= F.col("tradable_at")) & (F.col("obs_date") > F.date_sub("d", 10))
    return s.join(p, seen, "left").groupBy("idx").agg(F.count("value").alias("n"))


@query("execution_availability_all", "h_pit h_signal", """
    SELECT s.idx, CAST(count(p.value) AS BIGINT) AS n FROM h_signal s LEFT JOIN h_pit p
        ON p.released_at <= s.decision_at AND p.released_at + INTERVAL 15 HOUR <= s.tradable_at AND p.obs_date > s.d - 10 GROUP BY 1""")
def execution_availability_all(spark, sf):
    """``execution_availability`` over every series and date. No release comes before its
    date, so what a signal sees lies in the weeks from nine days before it to its own."""
    week = lambda c: F.date_trunc("week", c).cast("date")
    p = h_pit(spark, sf).withColumn("w", week("obs_date"))
    s = h_signal(spark, sf).withColumn("w", F.explode(F.sequence(week(F.date_sub("d", 9)), week("d"), F.expr("interval 7 days")))).alias("s")
    seen = (F.col("released_at") <= F.col("decision_at")) & (F.col("released_at") + F.expr("interval 15 hours") <= F.col("tradable_at")) & (F.col("obs_date") > F.date_sub("d", 10))
    return s.join(p.alias("p"), (F.col("s.w") == F.col("p.w")) & seen, "left").groupBy("idx").agg(F.count("value").alias("n"))


@query("sorted_unique_violations", "", """
    SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def sorted_unique_violations(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("manifest_completeness", "h_obs", """
    WITH dim(series_id) AS (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'), ('6-NEVER')), l AS (SELECT series_id, max(d) AS d, arg_max(v, d) AS v FROM h_obs WHERE d <= DATE '1998-03-15' GROUP BY 1)
    SELECT dim.series_id, CASE WHEN l.d IS NULL THEN 'MISSING' ELSE 'AVAILABLE' END AS status, l.d, l.v FROM dim LEFT JOIN l USING (series_id)""")
def manifest_completeness(spark, sf):
    dim = spark.createDataFrame([(x,) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NEVER")], "series_id string")
    last = h_obs(spark, sf).where("d <= date'1998-03-15'").groupBy("series_id").agg(F.max("d").alias("d"), F.max_by("v", "d").alias("v"))
    got = F.broadcast(dim).join(last, "series_id", "right").unionByName(dim.join(last, "series_id", "left_anti"), allowMissingColumns=True)
    return got.select("series_id", F.when(F.col("d").isNull(), "MISSING").otherwise("AVAILABLE").alias("status"), "d", "v")


@query("provenance_reasons", "", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'NOT_PIT' WHEN o_totalprice <= 1000 THEN 'INVALID_VALUE' WHEN o_orderdate >= TIMESTAMP '2001-01-01' THEN 'NOT_VISIBLE' END AS reason FROM orders""")
def provenance_reasons(spark, sf):
    reason = F.when(F.col("o_orderstatus") == "P", "NOT_PIT").when(F.col("o_totalprice") <= 1000, "INVALID_VALUE").when(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp"), "NOT_VISIBLE")
    return table(spark, sf, "orders").select("o_orderkey", reason.alias("reason"))


@query("attempt_completeness", "", """
    WITH a AS (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY 1, 2), t(event_type) AS (VALUES ('view'), ('click'), ('purchase'), ('signup'), ('error'), ('refund'))
    SELECT u.user_id, t.event_type FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN t ANTI JOIN a ON a.user_id = u.user_id AND a.event_type = t.event_type""")
def attempt_completeness(spark, sf):
    events = table(spark, sf, "events")
    kinds = F.explode(F.array(*[F.lit(x) for x in ("view", "click", "purchase", "signup", "error", "refund")]))
    wanted = events.select("user_id").distinct().select("user_id", kinds.alias("event_type"))
    return wanted.join(events.select("user_id", "event_type").distinct(), ["user_id", "event_type"], "left_anti")


@query("quote_divergence", "", """
    WITH q AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type AS provider, avg(value) AS v FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2, 3)
    SELECT a.user_id, a.d, round(abs(a.v - b.v) / greatest(abs(a.v), abs(b.v), 1e-9), 6) AS gap, round(abs(a.v - b.v) / greatest(abs(a.v), abs(b.v), 1e-9), 6) > 0.5 AS divergent
    FROM q a JOIN q b ON a.user_id = b.user_id AND a.d = b.d WHERE a.provider = 'click' AND b.provider = 'view'""")
def quote_divergence(spark, sf):
    q = table(spark, sf, "events").where("event_type in ('click', 'view')").groupBy("user_id", F.to_date("ts").alias("d")).agg(
        F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("a"), F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("b")
    )
    gap = F.round(F.abs(F.col("a") - F.col("b")) / F.greatest(F.abs("a"), F.abs("b"), F.lit(1e-9)), 6)
    return q.where("a is not null and b is not null").select("user_id", "d", gap.alias("gap"), (gap > 0.5).alias("divergent"))


@query("primary_channel", "h_week", """
    WITH o AS (SELECT series_id, max(d) AS od FROM h_week WHERE series_id <> '3-MEDIUM' GROUP BY 1), n AS (SELECT series_id, max(d) - CAST(substr(series_id, 1, 1) AS INTEGER) % 2 AS nd FROM h_week GROUP BY 1)
    SELECT n.series_id, CASE WHEN od IS NULL OR nd > od THEN 'nowcast' ELSE 'official' END AS channel FROM n LEFT JOIN o USING (series_id)""")
def primary_channel(spark, sf):
    week = h_week(spark, sf)
    o = week.where("series_id <> '3-MEDIUM'").groupBy("series_id").agg(F.max("d").alias("od"))
    n = week.groupBy("series_id").agg(F.max("d").alias("nd")).withColumn("nd", F.date_sub("nd", F.substring("series_id", 1, 1).cast("int") % 2))
    return n.join(o, "series_id", "left").select("series_id", F.when(F.col("od").isNull() | (F.col("nd") > F.col("od")), "nowcast").otherwise("official").alias("channel"))


@query("ledger_summary", "", """
    SELECT p_brand AS family, CAST(sum(p_size * (p_partkey % 3 + 1)) AS BIGINT) AS trials, CAST(count(DISTINCT p_type) AS BIGINT) AS candidates FROM part GROUP BY 1""")
def ledger_summary(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("family")).agg(F.sum(F.col("p_size") * (F.col("p_partkey") % 3 + 1)).cast("long").alias("trials"), F.count_distinct("p_type").alias("candidates"))


@query("same_regime_sample", "h_signal", """
    SELECT idx, CAST(count(*) OVER (PARTITION BY verdict ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS prior_same FROM h_signal""")
def same_regime_sample(spark, sf):
    return h_signal(spark, sf).select("idx", F.count(F.lit(1)).over(W.partitionBy("verdict").orderBy("d").rowsBetween(W.unboundedPreceding, -1)).alias("prior_same"))


@query("candidate_verdicts", "h_factor h_pairs", "WITH fp AS (SELECT f.factor, f.f, p.fwd FROM h_factor f JOIN h_pairs p ON CAST(date_trunc('week', p.d) AS DATE) = f.w), s AS ("
       + SPEARMAN.format(k="factor", x="f", y="fwd", t="fp", empty="0") + """)
    SELECT factor, CASE WHEN (ic - 0.02 > 0 OR (0.05 < 0.10 AND ic > 0)) AND (0.004 > 0.003 OR abs(ic) > 0.05) AND n >= 10 THEN 'PASS' WHEN abs(ic) > 0.05 OR abs(ic) > 0.05 THEN 'DISPLAY-ONLY' ELSE 'DROP' END AS verdict FROM s""")
def candidate_verdicts(spark, sf):
    pairs = h_pairs(spark, sf).select(F.date_trunc("week", "d").cast("date").alias("w"), "fwd")
    s = X.spearman(h_factor(spark, sf).join(pairs, "w"), "f", "fwd", ["factor"]).withColumn("ic", F.round("ic", 6))
    return s.select("factor", C.candidate_verdict("ic", F.col("ic") - 0.02, F.col("ic") + 0.02, F.lit(0.05), F.lit(0.004), "ic", "n", 1).alias("verdict"))


