"""Queries: labels, statistics, folds, scheduling and portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import params as P
from ..functions import scores as C
from ..functions.scalars import ieee_div
from ..operators import asof as A
from ..operators import labels as L
from ..operators import sets as T
from ..operators import simulate as M
from ..operators import stats as X
from ..operators import windows as N
from .harness import REL, h_factor, h_obs, h_pairs, h_price, h_rate, h_signal, h_vix, h_week, query, r6

SPEARMAN = """SELECT {k}, n, round(CASE WHEN n < 3 OR vx = 0 OR vy = 0 THEN {empty} ELSE r END, 6) AS ic FROM
    (SELECT {k}, CAST(count(*) AS BIGINT) AS n, var_pop(rx) AS vx, var_pop(ry) AS vy, CASE WHEN var_pop(rx) * var_pop(ry) > 0 THEN corr(rx, ry) END AS r FROM
        (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2 AS rx,
                   rank() OVER (PARTITION BY {k} ORDER BY {y}) + (count(*) OVER (PARTITION BY {k}, {y}) - 1) / 2 AS ry FROM {t}) GROUP BY {k})"""

HORIZON_PAIRS = """hp AS (SELECT weeks, s.d, s.score, s.verdict, p.d AS outcome_d, p.close / b.close - 1 AS fwd FROM
    (SELECT * FROM h_signal CROSS JOIN (VALUES (4), (8), (13)) h(weeks)) s JOIN h_price b ON b.d = s.d
    ASOF JOIN h_price p ON p.d >= s.d + 7 * s.weeks WHERE p.d - (s.d + 7 * s.weeks) <= 14)"""


def horizon_pairs(spark, sf):
    rows, prices = h_signal(spark, sf), h_price(spark, sf)
    out = None
    for weeks in (4, 8, 13):
        part = L.forward_pairs(rows, prices, days=7 * weeks, tolerance=14, keys=[]).withColumn("weeks", F.lit(weeks))
        out = part if out is None else out.unionByName(part)
    return out


@query("forward_pairs", "h_pairs", "SELECT d, outcome_d, score, round(fwd, 6) AS fwd FROM h_pairs")
def forward_pairs(spark, sf):
    return h_pairs(spark, sf).select("d", "outcome_d", "score", r6("fwd", "fwd"))


@query("forward_pairs_delayed", "h_price h_signal", """
    SELECT s.d, a.d AS entry_d, b.d AS outcome_d, round(b.close / a.close - 1, 6) AS fwd FROM h_signal s
    ASOF JOIN h_price a ON a.d >= s.d + 3 ASOF JOIN h_price b ON b.d >= a.d + 91 WHERE a.d - (s.d + 3) <= 7 AND b.d - (a.d + 91) <= 7""")
def forward_pairs_delayed(spark, sf):
    got = L.forward_pairs(h_signal(spark, sf), h_price(spark, sf), days=91, tolerance=7, keys=[], delay=3, delay_tolerance=7)
    return got.select("d", "entry_d", "outcome_d", r6("fwd", "fwd"))


@query("ic_by_horizon", "h_price h_signal", f"WITH {HORIZON_PAIRS} " + SPEARMAN.format(k="weeks", x="score", y="fwd", t="hp", empty="0"))
def ic_by_horizon(spark, sf):
    return X.spearman(horizon_pairs(spark, sf), "score", "fwd", ["weeks"]).select("weeks", "n", r6("ic", "ic"))


@query("backtest_by_horizon", "h_price h_signal", f"""WITH {HORIZON_PAIRS}
    SELECT weeks, CAST(count(*) AS BIGINT) AS n, round(corr(score, fwd), 6) AS pearson, round(avg(CASE WHEN (score >= 50) = (fwd >= 0) THEN 1.0 ELSE 0 END), 6)::DOUBLE AS hit_rate,
        round(avg(fwd), 6) AS mean_fwd, round(stddev_samp(fwd), 6) AS sd_fwd FROM hp GROUP BY 1""")
def backtest_by_horizon(spark, sf):
    return horizon_pairs(spark, sf).groupBy("weeks").agg(
        F.count(F.lit(1)).alias("n"), r6(X.correlation("score", "fwd"), "pearson"), r6(X.hit_rate("score", "fwd"), "hit_rate"),
        r6(F.avg("fwd"), "mean_fwd"), r6(F.stddev_samp("fwd"), "sd_fwd"),
    )


@query("factor_ic", "h_factor h_pairs", "WITH fp AS (SELECT f.factor, f.f, p.fwd FROM h_factor f JOIN h_pairs p ON CAST(date_trunc('week', p.d) AS DATE) = f.w) "
       + SPEARMAN.format(k="factor", x="f", y="fwd", t="fp", empty="0"))
def factor_ic(spark, sf):
    pairs = h_pairs(spark, sf).select(F.date_trunc("week", "d").cast("date").alias("w"), "fwd")
    return X.spearman(h_factor(spark, sf).join(pairs, "w"), "f", "fwd", ["factor"]).select("factor", "n", r6("ic", "ic"))


@query("factor_correlation", "h_factor", """
    SELECT a.factor AS a, b.factor AS b, CAST(count(*) AS BIGINT) AS n, round(corr(a.f, b.f), 6) AS r FROM h_factor a JOIN h_factor b ON a.w = b.w AND a.factor < b.factor GROUP BY 1, 2""")
def factor_correlation(spark, sf):
    f = h_factor(spark, sf)
    a, b = f.select("w", F.col("factor").alias("a"), F.col("f").alias("x")), f.select("w", F.col("factor").alias("b"), F.col("f").alias("y"))
    return a.join(b, "w").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), r6(X.correlation("x", "y"), "r"))


@query("residual_ic", "h_factor h_pairs", """
    WITH fp AS (SELECT f.factor, f.f, c.f AS base, p.fwd FROM h_factor f JOIN h_factor c ON c.w = f.w AND c.factor = '1-URGENT' AND f.factor <> '1-URGENT'
        JOIN h_pairs p ON CAST(date_trunc('week', p.d) AS DATE) = f.w),
    r AS (SELECT *, rank() OVER (PARTITION BY factor ORDER BY f) + (count(*) OVER (PARTITION BY factor, f) - 1) / 2 AS rf,
        rank() OVER (PARTITION BY factor ORDER BY base) + (count(*) OVER (PARTITION BY factor, base) - 1) / 2 AS rb,
        rank() OVER (PARTITION BY factor ORDER BY fwd) + (count(*) OVER (PARTITION BY factor, fwd) - 1) / 2 AS ry FROM fp),
    g AS (SELECT factor, regr_slope(rf, rb) AS b, regr_intercept(rf, rb) AS a FROM r GROUP BY 1),
    e AS (SELECT r.factor, round(rf - a - b * rb, 6) AS res, ry FROM r JOIN g USING (factor)),
    k AS (SELECT factor, ry, rank() OVER (PARTITION BY factor ORDER BY res) + (count(*) OVER (PARTITION BY factor, res) - 1) / 2 AS rr FROM e)
    SELECT factor, CAST(count(*) AS BIGINT) AS n, round(corr(rr, ry), 6) AS ic FROM k GROUP BY 1""")
def residual_ic(spark, sf):
    f = h_factor(spark, sf)
    base = f.where("factor = '1-URGENT'").select("w", F.col("f").alias("base"))
    pairs = h_pairs(spark, sf).select(F.date_trunc("week", "d").cast("date").alias("w"), "fwd")
    rows = f.where("factor <> '1-URGENT'").join(base, "w").join(pairs, "w")
    rows = rows.withColumn("rf", N.average_rank("f", ["factor"])).withColumn("rb", N.average_rank("base", ["factor"]))
    fit = rows.groupBy("factor").agg(F.expr("regr_slope(rf, rb)").alias("b"), F.expr("regr_intercept(rf, rb)").alias("a"))
    rest = rows.join(fit, "factor").withColumn("res", F.round(F.col("rf") - F.col("a") - F.col("b") * F.col("rb"), 6))
    return X.spearman(rest, "res", "fwd", ["factor"]).select("factor", "n", r6("ic", "ic"))


@query("hit_rates_typed", "h_pairs", """
    WITH c AS (SELECT verdict, count(*) FILTER (score <> 50 AND fwd <> 0) AS n, count(*) FILTER (score <> 50 AND fwd <> 0 AND (score > 50) = (fwd > 0)) AS k FROM h_pairs GROUP BY 1)
    SELECT verdict, CAST(n AS BIGINT) AS n, CASE WHEN n = 0 THEN 'NO_ELIGIBLE_OBSERVATIONS' WHEN n < 5 THEN 'INSUFFICIENT_SAMPLE' ELSE 'OK' END AS status,
        CASE WHEN n >= 5 THEN round(k / n, 6) END AS value FROM c""")
def hit_rates_typed(spark, sf):
    rows = h_pairs(spark, sf).groupBy("verdict").agg(X.direction_rate("score", "fwd").alias("r"))
    return rows.select("verdict", "r.n", "r.status", r6("r.value", "value"))


@query("validation_metrics", "h_pairs", """
    WITH q AS (SELECT quantile_cont(fwd, 0.1) AS q10 FROM h_pairs),
    c AS (SELECT count(*) FILTER (verdict <> 'NEUTRAL' AND fwd <> 0) AS vn, count(*) FILTER (verdict <> 'NEUTRAL' AND fwd <> 0 AND (verdict = 'BULLISH') = (fwd > 0)) AS vk,
        count(*) FILTER (target_exposure <= 0.5) AS calls, count(*) FILTER (fwd < 0) AS falls, count(*) FILTER (target_exposure <= 0.5 AND fwd < 0) AS caught,
        count(*) FILTER (fwd <= q10) AS tails, count(*) FILTER (target_exposure <= 0.5 AND fwd <= q10) AS tcaught, any_value(q10) AS q10 FROM h_pairs, q)
    SELECT round(q10, 6) AS q10, round(vk / vn, 6) AS verdict_rate, round(caught / calls, 6) AS precision_, round(caught / falls, 6) AS recall,
        round(tcaught / calls, 6) AS tail_precision, round(tcaught / tails, 6) AS tail_recall FROM c""")
def validation_metrics(spark, sf):
    pairs = h_pairs(spark, sf)
    q = pairs.agg(F.expr("percentile(fwd, 0.1D)").alias("q10"))
    precision, recall = X.risk_rates("target_exposure", "fwd")
    tp, tr = X.tail_rates("target_exposure", "fwd", "q10")
    got = pairs.crossJoin(F.broadcast(q)).groupBy("q10").agg(
        X.verdict_rate("verdict", "fwd").alias("v"), precision.alias("p"), recall.alias("r"), tp.alias("tp"), tr.alias("tr")
    )
    names = {"verdict_rate": "v", "precision_": "p", "recall": "r", "tail_precision": "tp", "tail_recall": "tr"}
    return got.select(r6("q10", "q10"), *[r6(f"{c}.value", k) for k, c in names.items()])


@query("quantiles_type7", "h_obs", """
    SELECT series_id, round(quantile_cont(v, 0.025), 6) AS q025, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.975), 6) AS q975 FROM h_obs GROUP BY 1""")
def quantiles_type7(spark, sf):
    q = lambda p, n: r6(F.expr(f"percentile(v, {p}D)"), n)
    return h_obs(spark, sf).groupBy("series_id").agg(q(0.025, "q025"), q(0.5, "q50"), q(0.975, "q975"))


@query("regime_breakdown", "h_pairs", """
    WITH l AS (SELECT axis, label, score, fwd FROM h_pairs, LATERAL (VALUES ('verdict', verdict), ('year', CAST(year(d) AS VARCHAR)), ('half', CASE WHEN month(d) <= 6 THEN 'H1' ELSE 'H2' END)) x(axis, label)),
    r AS (SELECT *, rank() OVER (PARTITION BY axis, label ORDER BY score) + (count(*) OVER (PARTITION BY axis, label, score) - 1) / 2 AS rx,
        rank() OVER (PARTITION BY axis, label ORDER BY fwd) + (count(*) OVER (PARTITION BY axis, label, fwd) - 1) / 2 AS ry FROM l)
    SELECT axis, label, CAST(count(*) AS BIGINT) AS n, round(CASE WHEN count(*) >= 3 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) ELSE 0 END, 6) AS ic FROM r GROUP BY 1, 2""")
def regime_breakdown(spark, sf):
    half = F.when(F.month("d") <= 6, "H1").otherwise("H2")
    axes = F.array(*[F.struct(F.lit(n).alias("axis"), c.alias("label")) for n, c in (("verdict", F.col("verdict")), ("year", F.year("d").cast("string")), ("half", half))])
    rows = h_pairs(spark, sf).select("score", "fwd", F.explode(axes).alias("x")).select("score", "fwd", "x.*")
    return X.spearman(rows, "score", "fwd", ["axis", "label"]).select("axis", "label", "n", r6("ic", "ic"))


@query("quintile_table", "h_pairs", """
    WITH q AS (SELECT fwd, CAST(ceil(5.0 * row_number() OVER (ORDER BY score, d) / count(*) OVER ()) AS BIGINT) AS quintile FROM h_pairs)
    SELECT quintile, CAST(count(*) AS BIGINT) AS n, round(avg(fwd), 6) AS mean, round(median(fwd), 6) AS median, round(avg(CASE WHEN fwd < 0 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS p_negative,
        round(quantile_cont(fwd, 0.1), 6) AS tail FROM q GROUP BY 1""")
def quintile_table(spark, sf):
    return X.quintile(h_pairs(spark, sf), ["score", "d"], []).groupBy("quintile").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("fwd"), "mean"), r6(F.median("fwd"), "median"),
        r6(F.avg((F.col("fwd") < 0).cast("double")), "p_negative"), r6(F.expr("percentile(fwd, 0.1D)"), "tail"),
    )


@query("score_buckets", "h_pairs", """
    WITH b AS (SELECT i AS bucket FROM range(7) t(i)),
    p AS (SELECT fwd, CASE WHEN score = 100 THEN 6 WHEN score < 20 THEN 0 WHEN score < 35 THEN 1 WHEN score < 45 THEN 2 WHEN score < 55 THEN 3 WHEN score < 65 THEN 4 WHEN score < 80 THEN 5 ELSE 6 END AS bucket FROM h_pairs)
    SELECT b.bucket, CAST(count(fwd) AS BIGINT) AS n, round(avg(fwd), 6) AS mean, round(median(fwd), 6) AS median,
        CASE WHEN count(fwd) >= 5 THEN round(avg(CASE WHEN fwd < 0 THEN 1.0 WHEN fwd IS NOT NULL THEN 0 END), 6)::DOUBLE END AS p_negative,
        CASE WHEN count(fwd) >= 5 THEN round(quantile_cont(fwd, 0.1), 6) END AS q10 FROM b LEFT JOIN p USING (bucket) GROUP BY 1""")
def score_buckets(spark, sf):
    dim = spark.range(len(P.BUCKETS) - 1).select(F.col("id").alias("bucket"))
    rows = dim.join(h_pairs(spark, sf).select("fwd", X.bucket("score").alias("bucket")), "bucket", "left")
    n = F.count("fwd")
    return rows.groupBy("bucket").agg(
        n.alias("n"), r6(F.avg("fwd"), "mean"), r6(F.median("fwd"), "median"),
        F.when(n >= 5, F.round(F.avg((F.col("fwd") < 0).cast("double")), 6)).alias("p_negative"),
        F.when(n >= 5, F.round(F.expr("percentile(fwd, 0.1D)"), 6)).alias("q10"),
    )


@query("purged_folds", "h_pairs", """
    WITH p AS (SELECT *, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM h_pairs),
    f AS (SELECT k AS fold, 200 + 52 * k AS lo, min(d) AS test_from FROM p, (SELECT unnest(range((SELECT count(*) // 52 + 1 FROM p))) AS k) WHERE i >= 200 + 52 * k AND i < 252 + 52 * k GROUP BY 1, 2)
    SELECT fold, test_from, split, CAST(count(*) AS BIGINT) AS n, max(outcome_d) AS label_through FROM
        (SELECT f.fold, test_from, outcome_d, CASE WHEN i >= lo THEN 'TEST' WHEN outcome_d >= test_from THEN 'PURGED' WHEN outcome_d >= test_from - 91 THEN 'EMBARGOED' ELSE 'KEPT' END AS split
         FROM f JOIN p ON i < lo + 52) GROUP BY 1, 2, 3""")
def purged_folds(spark, sf):
    pairs = h_pairs(spark, sf).withColumn("i", F.row_number().over(W.orderBy("d")) - 1)
    fold = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.count(F.lit(1)) / P.TEST_PAIRS)))
    folds = pairs.agg(fold.alias("fold")).withColumn("lo", F.col("fold") * P.TEST_PAIRS + P.TRAIN_PAIRS)
    inside = pairs.join(folds, F.col("i") < F.col("lo") + P.TEST_PAIRS)
    start = F.min(F.when(F.col("i") >= F.col("lo"), F.col("d"))).over(W.partitionBy("fold"))
    rows = T.purge(inside.withColumn("test_from", start).where("test_from is not null"), F.col("test_from"))
    rows = rows.withColumn("split", F.when(F.col("i") >= F.col("lo"), "TEST").otherwise(F.col("split")))
    return rows.groupBy("fold", "test_from", "split").agg(F.count(F.lit(1)).alias("n"), F.max("outcome_d").alias("label_through"))


@query("walk_forward_weights", "h_factor h_pairs", """
    WITH fp AS (SELECT f.factor, f.f, p.fwd, year(p.outcome_d) AS y FROM h_factor f JOIN h_pairs p ON CAST(date_trunc('week', p.d) AS DATE) = f.w),
    t AS (SELECT k AS fold, factor, f, fwd FROM fp, range(1997, 2002) r(k) WHERE y < k),
    i AS (SELECT fold, factor, count(*) AS n, CASE WHEN count(*) >= 3 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) ELSE 0 END AS ic FROM
        (SELECT *, rank() OVER (PARTITION BY fold, factor ORDER BY f) + (count(*) OVER (PARTITION BY fold, factor, f) - 1) / 2 AS rx,
            rank() OVER (PARTITION BY fold, factor ORDER BY fwd) + (count(*) OVER (PARTITION BY fold, factor, fwd) - 1) / 2 AS ry FROM t) GROUP BY 1, 2),
    s AS (SELECT *, sum(greatest(ic, 0)) OVER (PARTITION BY fold) AS total, count(*) FILTER (n >= 3) OVER (PARTITION BY fold) AS m FROM i)
    SELECT fold, factor, CAST(n AS BIGINT) AS n, round(ic, 6) AS ic, round(CASE WHEN total > 0 THEN greatest(ic, 0) / total ELSE 1 / m END, 6) AS weight FROM s""")
def walk_forward_weights(spark, sf):
    pairs = h_pairs(spark, sf).select(F.date_trunc("week", "d").cast("date").alias("w"), "fwd", F.year("outcome_d").alias("y"))
    folds = spark.range(1997, 2002).select(F.col("id").alias("fold"))
    rows = h_factor(spark, sf).join(pairs, "w").join(F.broadcast(folds), F.col("y") < F.col("fold"))
    ics = X.ic_weights(X.spearman(rows, "f", "fwd", ["fold", "factor"]), ["fold"])
    return ics.select("fold", "factor", "n", r6("ic", "ic"), r6("weight", "weight"))


GREEDY = """
    WITH RECURSIVE o AS (SELECT *, row_number() OVER (ORDER BY {order}) AS i FROM h_pairs),
    g AS (SELECT i, d, outcome_d FROM o WHERE i = 1
        UNION ALL SELECT n.i, n.d, n.outcome_d FROM g, LATERAL (SELECT * FROM o WHERE o.i > g.i AND o.d >= g.outcome_d ORDER BY o.i LIMIT 1) n)
    SELECT d, outcome_d FROM g"""


@query("independent_earliest_exit", "h_pairs", GREEDY.format(order="outcome_d, d"))
def independent_earliest_exit(spark, sf):
    return T.earliest_exit_set(h_pairs(spark, sf), []).select("d", "outcome_d")


@query("independent_chronological", "h_pairs", GREEDY.format(order="d, outcome_d"))
def independent_chronological(spark, sf):
    return T.chronological_set(h_pairs(spark, sf), []).select("d", "outcome_d")


@query("independent_calendar_step", "h_signal", """
    WITH RECURSIVE g AS (SELECT min(d) AS d FROM h_signal UNION ALL SELECT (SELECT min(s.d) FROM h_signal s WHERE s.d >= g.d + 91) FROM g WHERE g.d IS NOT NULL)
    SELECT d FROM g WHERE d IS NOT NULL""")
def independent_calendar_step(spark, sf):
    return T.calendar_step_set(h_signal(spark, sf).select("d"), [], 91)


@query("benjamini_hochberg", "", """
    WITH t AS (SELECT c_mktsegment AS family, c_custkey AS hypothesis_id, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE ((c_custkey * 7919) % 10007) / 10007 * (c_custkey % 5 + 1) / 50 END AS p_value FROM customer),
    e AS (SELECT *, coalesce(p_value, 1) AS effective_p FROM t),
    r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY effective_p, hypothesis_id) AS rank, count(*) OVER (PARTITION BY family) AS m FROM e)
    SELECT family, hypothesis_id, CAST(rank AS BIGINT) AS rank, CAST(m AS BIGINT) AS family_size,
        round(least(1, min(effective_p * m / rank) OVER (PARTITION BY family ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS adjusted_p FROM r""")
def benjamini_hochberg(spark, sf):
    from .harness import table

    k = F.col("c_custkey")
    p = F.when(k % 17 != 0, ((k * 7919) % 10007) / F.lit(10007.0) * (k % 5 + 1) / 50)
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("family"), k.alias("hypothesis_id"), p.alias("p_value"))
    return X.benjamini_hochberg(rows).select("family", "hypothesis_id", "rank", "family_size", r6("adjusted_p", "adjusted_p"))


@query("normal_functions", "", """
    WITH p AS (SELECT i / 1000.0::DOUBLE AS p FROM range(1, 1000) t(i)), b AS (SELECT p, least(p, 1 - p) AS l, p - 0.5 AS q FROM p),
    c AS (SELECT p, l, q, q * q AS r, sqrt(-2 * ln(l)) AS t FROM b),
    z AS (SELECT p, CASE WHEN l < 0.02425 THEN sign(q) * -1 * (((((-0.00778489400243029 * t - 0.322396458041136) * t - 2.40075827716184) * t - 2.54973253934373) * t + 4.37466414146497) * t + 2.93816398269878)
            / ((((0.00778469570904146 * t + 0.32246712907004) * t + 2.445134137143) * t + 3.75440866190742) * t + 1)
        ELSE (((((-39.6968302866538 * r + 220.946098424521) * r - 275.928510446969) * r + 138.357751867269) * r - 30.6647980661472) * r + 2.50662827745924) * q
            / (((((-54.4760987982241 * r + 161.585836858041) * r - 155.698979859887) * r + 66.8013118877197) * r - 13.2806815528857) * r + 1) END AS z FROM c),
    e AS (SELECT p, z, abs(z) / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM z)
    SELECT p, round(z, 6) AS z, round(0.5 * (1 + sign(z) * (1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x))), 6) AS cdf FROM e""")
def normal_functions(spark, sf):
    from ..functions.scalars import normal_cdf, probit

    rows = spark.range(1, 1000).select((F.col("id") / F.lit(1000.0)).alias("p"))
    return rows.select("p", r6(probit("p"), "z"), r6(normal_cdf(probit("p")), "cdf"))


# ---------------------------------------------------------------- simulation

SCHEDULE = """e AS (SELECT s.*, p.d AS exec_d, p.close AS price FROM h_signal s ASOF LEFT JOIN (SELECT d, close, CAST(d AS TIMESTAMP) + INTERVAL 17 HOUR AS b FROM h_price) p ON s.tradable_at < p.b),
    t AS (SELECT *, CASE WHEN exec_d IS NULL THEN 'UNEXECUTED' WHEN row_number() OVER (PARTITION BY exec_d ORDER BY decision_at DESC, idx DESC) = 1 THEN 'EXECUTED' ELSE 'SUPERSEDED' END AS status FROM e),
    x AS (SELECT *, lag(target_exposure, 1, 0.0) OVER (ORDER BY exec_d) AS old_exposure FROM t WHERE status = 'EXECUTED')"""


def scheduled(spark, sf):
    return M.schedule(h_signal(spark, sf), h_price(spark, sf), keys=[])


@query("execution_schedule", "h_price h_signal", f"""WITH {SCHEDULE}
    SELECT t.idx, t.exec_d, t.status, x.old_exposure, x.target_exposure AS new_exposure FROM t LEFT JOIN x ON t.idx = x.idx""")
def execution_schedule(spark, sf):
    return scheduled(spark, sf).select("idx", "exec_d", "status", "old_exposure", "new_exposure")


PORTFOLIO = SCHEDULE + """,
    q AS (SELECT p.d, p.close, coalesce(last_value(x.target_exposure IGNORE NULLS) OVER (ORDER BY p.d ROWS UNBOUNDED PRECEDING), 0) AS target FROM h_price p LEFT JOIN x ON x.exec_d = p.d),
    s AS (SELECT d, close, target, lag(d) OVER (ORDER BY d) AS p, lag(close) OVER (ORDER BY d) AS pc, lag(target, 1, 0) OVER (ORDER BY d) AS held FROM q),
    j AS (SELECT s.*, r.rate, v.d AS vd, v.v FROM s ASOF LEFT JOIN h_rate r ON s.p > r.d ASOF LEFT JOIN h_vix v ON s.d >= v.d),
    c AS (SELECT d, target, CASE WHEN p IS NULL THEN 1 ELSE 1 + held * (close / pc - 1) + (1 - held) * coalesce(rate, 0) / 100 * (d - p) / 360 END
        * (1 - abs(target - held) * (3 + CASE WHEN vd IS NULL OR d - vd > 4 OR v >= 28 THEN 3 ELSE 0 END) / 10000) AS g FROM j),
    n AS (SELECT d, target, product(g) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS nav FROM c)"""


def portfolio(spark, sf):
    done = scheduled(spark, sf).where("status = 'EXECUTED'").select(F.col("exec_d").alias("d"), F.col("new_exposure").alias("target"))
    sessions = N.carry_forward(h_price(spark, sf).join(done, "d", "left"), "target", [])
    rates = h_rate(spark, sf)
    # no rate is fixed before the first session, where nothing is held
    first = h_price(spark, sf).agg(F.date_sub(F.min("d"), 10).alias("d"), F.lit(0.0).alias("rate"))
    return M.daily_portfolio(sessions, h_vix(spark, sf), rates.unionByName(first), keys=[])


@query("daily_nav", "h_price h_signal h_rate h_vix", f"WITH {PORTFOLIO} SELECT d, target, round(ln(nav), 6) AS log_nav FROM n WHERE d >= DATE '1995-02-01'")
def daily_nav(spark, sf):
    return portfolio(spark, sf).where("d >= date'1995-02-01'").select("d", "target", r6(F.log("nav"), "log_nav"))


@query("portfolio_metrics", "h_price h_signal h_rate h_vix", f"""WITH {PORTFOLIO},
    r AS (SELECT *, nav / lag(nav, 1, 1.0) OVER (ORDER BY d) - 1 AS ret, greatest(1, max(nav) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING)) AS peak, lead(d) OVER (ORDER BY d) IS NULL AS is_last FROM n),
    k AS (SELECT *, sum(CASE WHEN nav >= peak THEN 1 ELSE 0 END) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS spell FROM r),
    b AS (SELECT *, sum(CASE WHEN nav < peak THEN 1 ELSE 0 END) OVER (PARTITION BY spell ORDER BY d ROWS UNBOUNDED PRECEDING) AS below FROM k)
    SELECT round(ln(arg_max(nav, d)), 5) AS log_return, round(avg(target) FILTER (NOT is_last), 5) AS average_beta, round(stddev_pop(ret) * sqrt(252), 5) AS volatility,
        round(avg(ret) / stddev_pop(ret) * sqrt(252), 5) AS sharpe, round(avg(ret) / sqrt(sum(least(ret, 0) * least(ret, 0)) / count(*)) * sqrt(252), 5) AS sortino,
        round(min(nav / peak - 1), 5) AS max_drawdown, CAST(max(below) AS BIGINT) AS drawdown_sessions FROM b""")
def portfolio_metrics(spark, sf):
    got = M.portfolio_metrics(portfolio(spark, sf).withColumn("book", F.lit("strategy")), keys=["book"])
    five = lambda c: F.round(c, 5).alias(c)
    got = got.withColumn("log_return", F.log(F.col("total_return") + 1))
    return got.select(*[five(c) for c in ("log_return", "average_beta", "volatility", "sharpe", "sortino", "max_drawdown")], "drawdown_sessions")


@query("formal_outcomes", "h_price h_signal", f"""WITH {SCHEDULE},
    o AS (SELECT x.idx, x.exec_d, x.price, weeks, x.exec_d + 7 * weeks AS target_d FROM x CROSS JOIN (VALUES (4), (8), (13)) h(weeks)),
    g AS (SELECT o.*, p.d AS xd, p.close AS xc FROM o ASOF LEFT JOIN h_price p ON o.target_d <= p.d),
    s AS (SELECT *, CASE WHEN xd - target_d <= 14 THEN 'OK' WHEN TIMESTAMP '2001-06-01' <= target_d + 15 THEN 'PENDING_OUTCOME' ELSE 'MISSING_PRICE_COVERAGE' END AS status FROM g),
    w AS (SELECT s.idx, s.weeks, min(p.close / p.peak - 1) AS worst FROM s, LATERAL (SELECT close, max(close) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS peak FROM h_price WHERE d BETWEEN s.exec_d AND s.xd) p WHERE status = 'OK' GROUP BY 1, 2)
    SELECT s.idx, s.weeks, status, CASE WHEN status = 'OK' THEN xd END AS exit_d, CASE WHEN status = 'OK' THEN round(xc / price - 1, 6) END AS total_return, round(worst, 6) AS worst_drawdown FROM s LEFT JOIN w USING (idx, weeks)""")
def formal_outcomes(spark, sf):
    prices = h_price(spark, sf)
    done = scheduled(spark, sf).where("status = 'EXECUTED'").select("idx", "exec_d")
    done = done.join(prices.select(F.col("d").alias("exec_d"), F.col("close").alias("price")), "exec_d")
    got = M.outcomes(done, prices, F.lit("2001-06-01").cast("timestamp"), keys=[])
    return got.select("idx", "weeks", "status", "exit_d", r6("total_return", "total_return"), r6("worst_drawdown", "worst_drawdown"))


@query("strategy_stats", "h_signal h_price", """
    WITH p AS (SELECT s.d, s.score, b.close, lead(b.close) OVER (ORDER BY s.d) / b.close - 1 AS ret FROM h_signal s JOIN h_price b USING (d)),
    r AS (SELECT d, CASE WHEN score > 55 THEN ret ELSE 0 END AS ret, ret AS hold FROM p WHERE ret IS NOT NULL)
    SELECT CAST(count(*) AS BIGINT) AS n, round(product(1 + ret) - 1, 5) AS total, round(product(1 + hold) - 1, 5) AS buy_hold, round(avg(ret) / stddev_samp(ret) * sqrt(52), 5) AS sharpe FROM r""")
def strategy_stats(spark, sf):
    hold = ieee_div(F.lead("close").over(W.orderBy("d")), "close") - 1
    rows = h_signal(spark, sf).join(h_price(spark, sf), "d").withColumn("hold", hold).where("hold is not null")
    rows = rows.withColumn("ret", F.when(F.col("score") > 55, F.col("hold")).otherwise(0.0))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.product(F.col("ret") + 1) - 1, 5).alias("total"), F.round(F.product(F.col("hold") + 1) - 1, 5).alias("buy_hold"),
        F.round(ieee_div(F.avg("ret"), F.stddev_samp("ret")) * F.sqrt(F.lit(52.0)), 5).alias("sharpe"),  # NaN if nothing was held
    )


@query("stress_windows", "h_pairs", """
    WITH e(event, f, t) AS (VALUES ('spring96', DATE '1996-03-01', DATE '1996-06-01'), ('autumn98', DATE '1998-08-01', DATE '1998-11-01'), ('late', DATE '2001-07-01', DATE '2002-01-01'))
    SELECT event, CAST(count(p.d) AS BIGINT) AS n, CAST(count(*) FILTER (verdict = 'BEARISH') AS BIGINT) AS bearish, round(avg(target_exposure), 6) AS exposure, round(avg(fwd), 6) AS mean_fwd, round(min(fwd), 6) AS worst_fwd
    FROM e LEFT JOIN h_pairs p ON p.d >= e.f AND p.d < e.t GROUP BY 1""")
def stress_windows(spark, sf):
    e = spark.createDataFrame([("spring96", "1996-03-01", "1996-06-01"), ("autumn98", "1998-08-01", "1998-11-01"), ("late", "2001-07-01", "2002-01-01")], "event string, f string, t string")
    e = e.select("event", F.to_date("f").alias("f"), F.to_date("t").alias("t"))
    rows = e.join(h_pairs(spark, sf), (F.col("d") >= F.col("f")) & (F.col("d") < F.col("t")), "left")
    return rows.groupBy("event").agg(
        F.count("d").alias("n"), F.count_if(F.col("verdict") == "BEARISH").alias("bearish"), r6(F.avg("target_exposure"), "exposure"),
        r6(F.avg("fwd"), "mean_fwd"), r6(F.min("fwd"), "worst_fwd"),
    )


@query("turnover", "h_signal", """
    SELECT round(avg(abs(target_exposure - p)), 6) AS turnover FROM (SELECT target_exposure, lag(target_exposure) OVER (ORDER BY d) AS p FROM h_signal) WHERE p IS NOT NULL""")
def turnover(spark, sf):
    return h_signal(spark, sf).select(F.abs(F.col("target_exposure") - N.lag("target_exposure", 1, [])).alias("x")).agg(r6(F.avg("x"), "turnover"))


@query("lead_scan", "h_week h_price", """
    WITH g AS (SELECT a.w, a.v / nullif(b.v, 0) - 1 AS growth FROM h_week a JOIN h_week b ON b.series_id = a.series_id AND b.w = a.w - 91 WHERE a.series_id = '1-URGENT'),
    p AS (SELECT lead, g.growth, y.close / x.close - 1 AS fwd FROM (SELECT * FROM g CROSS JOIN (SELECT i AS lead FROM range(0, 27, 2) t(i))) g
        ASOF JOIN h_price x ON x.d <= g.w + CAST(7 * lead AS INTEGER) ASOF JOIN h_price y ON y.d <= g.w + CAST(7 * lead AS INTEGER) + 91
        WHERE g.w + CAST(7 * lead AS INTEGER) + 91 <= (SELECT max(d) FROM h_price)) """ + SPEARMAN.format(k="lead", x="growth", y="fwd", t="p", empty="0"))
def lead_scan(spark, sf):
    week, prices = h_week(spark, sf).where("series_id = '1-URGENT'"), h_price(spark, sf)
    old = week.select(F.date_add("w", 91).alias("w"), F.col("v").alias("b"))
    rows = week.join(old, "w").select("w", (F.col("v") / F.col("b") - 1).alias("growth"))
    rows = rows.withColumn("lead", F.explode(F.sequence(F.lit(0), F.lit(26), F.lit(2)))).withColumn("t0", F.expr("date_add(w, 7 * lead)")).withColumn("t1", F.date_add("t0", 91))
    end = prices.agg(F.max("d").alias("end"))  # one row
    rows = rows.crossJoin(F.broadcast(end)).where("t1 <= end").drop("end")
    rows = A.asof_last(rows, prices, keys=[], on="t0", data_on="d", carry=["close"], prefix="x_")
    rows = A.asof_last(rows, prices, keys=[], on="t1", data_on="d", carry=["close"], prefix="y_")
    rows = rows.where("x_close is not null").withColumn("fwd", F.col("y_close") / F.col("x_close") - 1)
    return X.spearman(rows, "growth", "fwd", ["lead"]).select(F.col("lead").cast("long").alias("lead"), "n", r6("ic", "ic"))


@query("tga_buffer", "h_week", """
    WITH t AS (SELECT w, v, v - lag(v) OVER (ORDER BY w) AS shock, w - lag(w) OVER (ORDER BY w) AS gap FROM h_week WHERE series_id = '2-HIGH'),
    b AS (SELECT t.w, t.shock, t.gap, r.v AS rrp, quantile_cont(r.v, 0.2) OVER x AS q20, quantile_cont(r.v, 0.5) OVER x AS q50, count(*) OVER x AS n
        FROM t ASOF JOIN (SELECT w, v FROM h_week WHERE series_id = '3-MEDIUM') r ON t.w >= r.w WINDOW x AS (ORDER BY t.w ROWS BETWEEN 156 PRECEDING AND 1 PRECEDING))
    SELECT w, CASE WHEN shock IS NULL THEN 'INSUFFICIENT_TGA_HISTORY' WHEN gap NOT BETWEEN 5 AND 10 THEN 'INVALID_TGA_CADENCE' WHEN n < 52 THEN 'INSUFFICIENT_RRP_HISTORY' ELSE 'OK' END AS status,
        CASE WHEN gap BETWEEN 5 AND 10 AND n >= 52 THEN round(shock * CASE WHEN rrp <= q20 THEN 1.0 WHEN rrp <= q50 THEN 0.6 ELSE 0.25 END::DOUBLE, 6) END AS effect FROM b""")
def tga_buffer(spark, sf):
    week = h_week(spark, sf)
    t = week.where("series_id = '2-HIGH'").select("w", (F.col("v") - N.lag("v", 1, [], "w")).alias("shock"), F.datediff("w", N.lag("w", 1, [], "w")).alias("gap"))
    b = A.asof_last(t, week.where("series_id = '3-MEDIUM'").select("w", "v"), keys=[], on="w", data_on="w", carry=["v"], prefix="r_").where("r_v is not null")
    b = b.selectExpr("*", *[f"{e} OVER (ORDER BY w ROWS BETWEEN 156 PRECEDING AND 1 PRECEDING) AS {n}" for e, n in (("percentile(r_v, 0.2D)", "q20"), ("percentile(r_v, 0.5D)", "q50"), ("count(*)", "n"))])
    status = (
        F.when(F.col("shock").isNull(), "INSUFFICIENT_TGA_HISTORY").when(~F.col("gap").between(5, 10), "INVALID_TGA_CADENCE")
        .when(F.col("n") < P.MAD_MIN, "INSUFFICIENT_RRP_HISTORY").otherwise("OK")
    )
    m = P.TGA_MULTIPLIERS
    mult = F.when(F.col("r_v") <= F.col("q20"), m[0]).when(F.col("r_v") <= F.col("q50"), m[1]).otherwise(m[2])
    return b.select("w", status.alias("status"), F.when(status == "OK", F.round(F.col("shock") * mult, 6)).alias("effect"))


@query("ablation_arms", "h_factor", """
    WITH w(factor, wt) AS (VALUES ('1-URGENT', 0.35), ('2-HIGH', 0.18), ('3-MEDIUM', 0.15), ('4-NOT SPECIFIED', 0.06), ('5-LOW', 0.04)),
    a(arm) AS (VALUES ('full'), ('no_credit'), ('no_funding'), ('neither')),
    s AS (SELECT arm, f.w, sum(f * wt) / sum(wt) AS score FROM h_factor f JOIN w USING (factor) CROSS JOIN a
        WHERE NOT (arm IN ('no_credit', 'neither') AND factor = '4-NOT SPECIFIED') AND NOT (arm IN ('no_funding', 'neither') AND factor = '5-LOW') GROUP BY 1, 2)
    SELECT arm, w, round(score, 6) AS score, coalesce(last_value(CASE WHEN round(score, 6) > 55 THEN 'BULLISH' WHEN round(score, 6) < 45 THEN 'BEARISH' END IGNORE NULLS) OVER (PARTITION BY arm ORDER BY w ROWS UNBOUNDED PRECEDING), 'NEUTRAL') AS verdict FROM s""")
def ablation_arms(spark, sf):
    weights = spark.createDataFrame([("1-URGENT", 0.35), ("2-HIGH", 0.18), ("3-MEDIUM", 0.15), ("4-NOT SPECIFIED", 0.06), ("5-LOW", 0.04)], "factor string, wt double")
    arms = spark.createDataFrame([("full", []), ("no_credit", ["4-NOT SPECIFIED"]), ("no_funding", ["5-LOW"]), ("neither", ["4-NOT SPECIFIED", "5-LOW"])], "arm string, dropped array<string>")
    rows = h_factor(spark, sf).join(F.broadcast(weights), "factor").crossJoin(F.broadcast(arms)).where(~F.array_contains("dropped", F.col("factor")))
    rows = rows.groupBy("arm", "w").agg(r6(F.sum(F.col("f") * F.col("wt")) / F.sum("wt"), "score"))
    return rows.select("arm", "w", "score", N.hysteresis(C.band("score"), ["arm"], "w").alias("verdict"))
