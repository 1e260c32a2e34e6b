"""Queries: whole flows (bootstraps, walk-forward, backtest, formal validation, dual horizon) and source checks.

Fields that the driver's tables lack (clocks, provenance, statuses) are made from
keys, so that every branch is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import params as P
from ..functions import scores as C
from ..functions.scalars import strict_date
from ..operators import asof as A
from ..operators import gates as G
from ..operators import sets as T
from ..operators import simulate as M
from ..operators import stats as X
from ..operators import windows as N
from .evaluation import PORTFOLIO, SCHEDULE, SPEARMAN, scheduled
from .harness import h_factor, h_obs, h_pairs, h_pit, h_price, h_rate, h_signal, h_vix, h_week, query, r6, table
from .rules import cycle

# ---------------------------------------------------------------- bootstraps

#: Draws of the counter-based generator: relation ``k`` (k) to ``u`` (k, u).
MULBERRY = """g0 AS (SELECT k, (12345 + (k + 1) * 1831565813) % 4294967296 AS a FROM k),
    g1 AS (SELECT k, CAST(CAST(xor(a, a >> 15) AS HUGEINT) * (a | 1) % 4294967296 AS BIGINT) AS t FROM g0),
    g2 AS (SELECT k, xor((t + CAST(CAST(xor(t, t >> 7) AS HUGEINT) * (t | 61) % 4294967296 AS BIGINT)) % 4294967296, t) AS t FROM g1),
    u AS (SELECT k, xor(t, t >> 14) / 4294967296::DOUBLE AS u FROM g2)"""
#: Resampled rows of relation ``b`` (idx and more) with draws from number ``{first}`` on.
RESAMPLE = """m AS (SELECT count(*) AS n, CAST(ceil(count(*) / 13) AS BIGINT) AS per FROM b), k AS (SELECT {first} + unnest(range(2000 * per)) AS k FROM m), {draws},
    st AS (SELECT (k - {first}) // per AS iter, (k - {first}) % per * 13 AS base, CAST(floor(u * n) AS BIGINT) AS start, n FROM u, m),
    sp AS (SELECT iter, (start + o) % n AS idx FROM st, range(13) r(o) WHERE base + o < n), s AS (SELECT iter, b.* FROM sp JOIN b USING (idx))"""
IC_STATS = "SELECT round(quantile_cont(ic, 0.025), 6) AS ci_low, round(quantile_cont(ic, 0.975), 6) AS ci_high, round(avg(CASE WHEN ic <= 0 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS p_value, CAST(count(ic) AS BIGINT) AS iterations FROM i"


def _iterations(stats: DataFrame, c: str) -> DataFrame:
    """Percentile bounds and the share of resamples at or under 0."""
    return stats.agg(
        r6(F.expr(f"percentile({c}, 0.025D)"), "ci_low"), r6(F.expr(f"percentile({c}, 0.975D)"), "ci_high"),
        r6(F.avg((F.col(c) <= 0).cast("double")), "p_value"), F.count(c).alias("iterations"),
    )


def _numbered_pairs(spark, sf) -> DataFrame:
    return h_pairs(spark, sf).select("score", "fwd", (F.row_number().over(W.orderBy("d")) - 1).alias("idx"))


@query("bootstrap_ic", "h_pairs", "WITH b AS (SELECT row_number() OVER (ORDER BY d) - 1 AS idx, score, fwd FROM h_pairs), " + RESAMPLE.format(first=0, draws=MULBERRY)
       + ", i AS (" + SPEARMAN.format(k="iter", x="score", y="fwd", t="s", empty="0").replace(", 6) AS ic", ", 12) AS ic") + ") " + IC_STATS)
def bootstrap_ic(spark, sf):
    """Circular block bootstrap of the IC, 2,000 resamples by the 32-bit generator."""
    pairs, b = _numbered_pairs(spark, sf), P.BOOTSTRAP
    rows = M.block_bootstrap(pairs, n=pairs.count(), block=b["block"], iterations=b["iterations"], draw=lambda k: M.mulberry32(b["seed"], k))
    return _iterations(X.spearman(rows, "score", "fwd", ["iter"]), "ic")


_LCG = """RECURSIVE b AS (SELECT row_number() OVER (ORDER BY d) - 1 AS idx, score, fwd FROM h_pairs), m AS (SELECT count(*) AS n, CAST(ceil(count(*) / 13) AS BIGINT) AS per FROM b),
    j AS (SELECT 0 AS m, 1664525::BIGINT AS a, 1013904223::BIGINT AS c UNION ALL SELECT m + 1, CAST(a::HUGEINT * a % 4294967296 AS BIGINT), CAST((a::HUGEINT * c + c) % 4294967296 AS BIGINT) FROM j WHERE m < 24),
    x AS (SELECT unnest(range(2000 * per)) AS k, 0 AS m, 11011::BIGINT AS x FROM m
        UNION ALL SELECT x.k, x.m + 1, CASE WHEN ((x.k + 1) >> x.m) & 1 = 1 THEN CAST((j.a::HUGEINT * x.x + j.c) % 4294967296 AS BIGINT) ELSE x.x END FROM x JOIN j ON j.m = x.m WHERE x.m < 24),
    st AS (SELECT k // per AS iter, k % per * 13 AS base, CAST(floor(x / 4294967296::DOUBLE * n) AS BIGINT) AS start, n FROM x, m WHERE x.m = 24),
    sp AS (SELECT iter, (start + o) % n AS idx FROM st, range(13) r(o) WHERE base + o < n), s AS (SELECT iter, b.* FROM sp JOIN b USING (idx))"""


@query("moving_block_bootstrap", "h_pairs", "WITH " + _LCG + ", i AS (" + SPEARMAN.format(k="iter", x="score", y="fwd", t="s", empty="NULL").replace(", 6) AS ic", ", 12) AS ic") + ") " + IC_STATS)
def moving_block_bootstrap(spark, sf):
    """The same with the linear congruential generator; resamples without an IC drop out."""
    pairs = _numbered_pairs(spark, sf)
    rows = M.block_bootstrap(pairs, n=pairs.count(), block=13, iterations=2000, draw=lambda k: M.lcg(11011, k))
    return _iterations(X.spearman(rows, "score", "fwd", ["iter"], None), "ic")


#: Weekly returns of the long-flat strategy: d, pos, ret, hold.
WEEKLY = """wk AS (SELECT s.d, s.score, p.close, lead(p.close) OVER (ORDER BY s.d) / p.close - 1 AS hold FROM h_signal s JOIN h_price p USING (d)),
    wr AS (SELECT d, CASE WHEN score > 55 THEN 1 ELSE 0 END AS pos, CASE WHEN score > 55 THEN hold ELSE 0 END AS ret, hold FROM wk WHERE hold IS NOT NULL)"""
YEARS = "(SELECT (max(d) - min(d)) / 365.25 FROM wk)"


def weekly_returns(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Returns of the long-flat strategy (score above 55) and one row: years."""
    rows = h_signal(spark, sf).join(h_price(spark, sf), "d")
    years = rows.agg((F.datediff(F.max("d"), F.min("d")) / F.lit(365.25)).alias("years"))
    rows = rows.withColumn("hold", F.lead("close").over(W.orderBy("d")) / F.col("close") - 1).where("hold is not null")
    pos = (F.col("score") > P.BULL_ABOVE).cast("long")
    return rows.select("d", pos.alias("pos"), (pos * F.col("hold")).alias("ret"), "hold"), years


def sharpe_sql(first: int | str) -> str:
    """The bootstrap of the Sharpe ratio with draws from number ``first`` on."""
    return f"""WITH {WEEKLY}, b AS (SELECT row_number() OVER (ORDER BY d) - 1 AS idx, ret FROM wr), """ + RESAMPLE.format(first=first, draws=MULBERRY) + f""",
    i AS (SELECT iter, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt((SELECT count(*) FROM b) / {YEARS}) ELSE 0 END AS ic FROM s GROUP BY 1) """ + IC_STATS


@query("bootstrap_sharpe", "h_price h_signal", sharpe_sql(0))
def bootstrap_sharpe(spark, sf):
    return sharpe_bootstrap(spark, sf, 0)


def sharpe_bootstrap(spark, sf, first: int) -> DataFrame:
    rows, years = weekly_returns(spark, sf)
    numbered = rows.select("ret", (F.row_number().over(W.orderBy("d")) - 1).alias("idx"))
    n, b = numbered.count(), P.BOOTSTRAP
    drawn = M.block_bootstrap(numbered, n=n, block=b["block"], iterations=b["iterations"], draw=lambda k: M.mulberry32(b["seed"], k), first=first)
    stats = drawn.groupBy("iter").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s")).crossJoin(F.broadcast(years))
    sharpe = F.when(F.col("s") > 0, F.col("m") / F.when(F.col("s") > 0, F.col("s")) * F.sqrt(F.lit(float(n)) / F.col("years"))).otherwise(0.0)
    return _iterations(stats.select(sharpe.alias("x")), "x")


@query("robustness_report", "h_price h_signal h_pairs", f"""WITH {WEEKLY},
    t AS (SELECT *, product(1 + ret) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS nav, abs(pos - lag(pos) OVER (ORDER BY d)) AS step FROM wr),
    q AS (SELECT *, greatest(1, max(nav) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING)) AS peak FROM t), f AS (SELECT 1 AS g, score, fwd FROM h_pairs), ic AS (""" + SPEARMAN.format(k="g", x="score", y="fwd", t="f", empty="0") + f""")
    SELECT (SELECT n FROM ic) AS n_pairs, (SELECT ic FROM ic) AS ic, CAST(count(*) AS BIGINT) AS n_periods, round(pow(product(1 + ret), 1 / {YEARS}) - 1, 6) AS ann_return,
        round(pow(product(1 + hold), 1 / {YEARS}) - 1, 6) AS buyhold_ann, round(min(nav / peak - 1), 6) AS max_drawdown, round(avg(step), 6) AS turnover, round(avg(step) * count(*) / {YEARS}, 6) AS turnover_annual FROM q""")
def robustness_report(spark, sf):
    """Sample, IC, annual returns, drawdown and turnover of the long-flat strategy in one row."""
    rows, years = weekly_returns(spark, sf)
    upto = W.orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("nav", F.product(F.col("ret") + 1).over(upto)).withColumn("step", F.abs(F.col("pos") - F.lag("pos").over(W.orderBy("d"))))
    rows = N.drawdown(rows, [], start=1.0).crossJoin(F.broadcast(years))
    annual = lambda c: F.pow(F.product(F.col(c) + 1), 1 / F.first("years")) - 1
    got = rows.agg(
        F.count(F.lit(1)).alias("n_periods"), r6(annual("ret"), "ann_return"), r6(annual("hold"), "buyhold_ann"), r6(F.min("drawdown"), "max_drawdown"),
        r6(F.avg("step"), "turnover"), r6(F.avg("step") * F.count(F.lit(1)) / F.first("years"), "turnover_annual"),
    )
    ic = X.spearman(h_pairs(spark, sf).withColumn("g", F.lit(1)), "score", "fwd", ["g"]).select(F.col("n").alias("n_pairs"), r6("ic", "ic"))
    return got.crossJoin(F.broadcast(ic))


def _probit_sql(p: str) -> str:
    """Inverse normal of a probability between the tails (0.02425 and its complement)."""
    q, r = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"
    return f"""(((((-39.6968302866538 * {r} + 220.946098424521) * {r} - 275.928510446969) * {r} + 138.357751867269) * {r} - 30.6647980661472) * {r} + 2.50662827745924) * {q}
        / (((((-54.4760987982241 * {r} + 161.585836858041) * {r} - 155.698979859887) * {r} + 66.8013118877197) * {r} - 13.2806815528857) * {r} + 1)"""


@query("deflated_sharpe", "h_factor", f"""
    WITH t AS (SELECT avg(f) / stddev_samp(f) / 10 AS s FROM h_factor GROUP BY factor), b AS (SELECT max(s) AS best, var_samp(s) AS v, count(*)::DOUBLE AS n FROM t),
    e AS (SELECT *, sqrt(v) * ((1 - 0.5772156649015329) * {_probit_sql('(1 - 1 / n)')} + 0.5772156649015329 * {_probit_sql('(1 - 1 / (n * 2.718281828459045))')}) AS expected FROM b),
    z AS (SELECT n, (best - expected) * sqrt(249) / sqrt(1 - 0.1 * best + 2.2 / 4 * best * best) AS z FROM e), w AS (SELECT n, z, abs(z) / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM z)
    SELECT round(0.5 * (1 + sign(z) * (1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x))), 6) AS dsr, n FROM w""")
def deflated_sharpe(spark, sf):
    """Sharpe ratios of the factors as trials of one search."""
    trials = h_factor(spark, sf).groupBy("factor").agg((F.avg("f") / F.stddev_samp("f") / 10).alias("s"))
    got = trials.agg(F.max("s").alias("best"), F.var_samp("s").alias("v"), F.count(F.lit(1)).cast("double").alias("n"))
    return got.select(r6(X.deflated_sharpe("best", "v", "n", F.lit(250.0), F.lit(0.1), F.lit(3.2)), "dsr"), "n")


# ---------------------------------------------------------------- walk-forward and out-of-sample gates

SNAPS = """sn AS (SELECT row_number() OVER (ORDER BY s.d) - 1 AS i, s.d, CAST(date_trunc('week', s.d) AS DATE) AS w, s.score, p.close, count(*) OVER () AS n FROM h_signal s JOIN h_price p USING (d)),
    sq AS (SELECT a.i, a.d, a.w, a.score, a.n, b.i AS j, b.d AS outcome_d, b.close / a.close - 1 AS fwd FROM sn a ASOF JOIN sn b ON b.d >= a.d + 91 WHERE b.d - a.d <= 105)"""
ARMS = {"current": (("1-URGENT", 0.35), ("2-HIGH", 0.18), ("3-MEDIUM", 0.15), ("4-NOT SPECIFIED", 0.06), ("5-LOW", 0.04))}
_CURRENT = "cw(factor, wt) AS (VALUES " + ", ".join(f"('{f}', {w}::DOUBLE)" for f, w in ARMS["current"]) + ")"


def snap_pairs(spark, sf) -> DataFrame:
    """Weekly rows paired with the first one 13 weeks later: i, j (ordinals), d, w, score, n, outcome_d, fwd."""
    rows = h_signal(spark, sf).select("d", "score").join(h_price(spark, sf), "d")
    rows = rows.withColumn("i", F.row_number().over(W.orderBy("d")) - 1).withColumn("n", F.count(F.lit(1)).over(W.partitionBy()))
    got = A.asof_first(rows.withColumn("t", F.date_add("d", 91)), rows, keys=[], on="t", data_on="d", carry=["close", "i"], prefix="x_").where(F.datediff("x_date", "d") <= 105)
    return got.select("i", F.col("x_i").alias("j"), "d", F.date_trunc("week", "d").cast("date").alias("w"), "score", "n", F.col("x_date").alias("outcome_d"), (F.col("x_close") / F.col("close") - 1).alias("fwd"))


_WALK = f"""{SNAPS}, {_CURRENT}, fo AS (SELECT k AS fold, 200 + 52 * k AS te FROM (SELECT unnest(range((SELECT max(n) // 52 + 1 FROM sn))) AS k) WHERE 213 + 52 * k < (SELECT max(n) FROM sn)),
    te AS (SELECT fold, te, sq.* FROM fo JOIN sq ON i >= te + 13 AND i < te + 65 QUALIFY count(*) OVER (PARTITION BY fold) >= 5),
    tr AS (SELECT fold || '|' || factor AS g, f, fwd FROM fo JOIN sq ON j < te JOIN h_factor USING (w)), ic AS (""" + SPEARMAN.format(k="g", x="f", y="fwd", t="tr", empty="0").replace(", 6) AS ic", ", 12) AS ic") + """),
    iw AS (SELECT CAST(split_part(g, '|', 1) AS BIGINT) AS fold, split_part(g, '|', 2) AS factor, n, greatest(ic, 0) * CAST(n >= 3 AS INTEGER) AS good FROM ic),
    ww AS (SELECT fold, factor, CASE WHEN sum(good) OVER p > 0 THEN good / sum(good) OVER p WHEN n >= 3 THEN 1 / count(*) FILTER (n >= 3) OVER p ELSE 0 END AS wt FROM iw WINDOW p AS (PARTITION BY fold)),
    aw AS (SELECT fold, 'fitted' AS arm, factor, wt FROM ww UNION ALL SELECT fold, 'current', factor, wt FROM fo, cw UNION ALL SELECT fold, 'equal', factor, 0.2 FROM fo, cw),
    sc AS (SELECT te.fold, te.te, arm, te.i, te.d, fwd, sum(f * wt) / sum(wt) AS s FROM te JOIN h_factor USING (w) JOIN aw ON aw.fold = te.fold AND aw.factor = h_factor.factor WHERE wt > 0 GROUP BY ALL)"""


def _folds(total: DataFrame, start: str) -> DataFrame:
    """fold and its first row (of a frame with one row, ``total`` rows): as many folds as the rows can hold."""
    fold = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.coalesce("total", F.lit(0)) / P.TEST_PAIRS)))
    return total.select(fold.alias("fold"), "total").select("fold", (F.col("fold") * P.TEST_PAIRS + P.TRAIN_PAIRS).alias(start), "total")


def _walk(spark, sf) -> DataFrame:
    pairs, fac = snap_pairs(spark, sf), h_factor(spark, sf).select("factor", "w", "f")
    total = pairs.agg(F.max("n").alias("total"))  # one row
    folds = _folds(total, "te").where(F.col("te") + P.HORIZON_WEEKS < F.col("total")).drop("total")
    test = pairs.join(folds, (F.col("i") >= F.col("te") + P.HORIZON_WEEKS) & (F.col("i") < F.col("te") + P.HORIZON_WEEKS + P.TEST_PAIRS))
    test = test.withColumn("k", F.count(F.lit(1)).over(W.partitionBy("fold"))).where("k >= 5")
    train = pairs.join(folds, F.col("j") < F.col("te")).join(fac, "w")
    ics = X.spearman(train, "f", "fwd", ["fold", "factor"]).withColumn("ic", F.round("ic", 12))
    fitted = X.ic_weights(ics, ["fold"]).select("fold", F.lit("fitted").alias("arm"), "factor", F.col("weight").alias("wt"))
    fixed = spark.createDataFrame([(arm, f, w) for f, cur in ARMS["current"] for arm, w in (("current", cur), ("equal", 0.2))], "arm string, factor string, wt double")
    weights = fitted.unionByName(folds.select("fold").crossJoin(F.broadcast(fixed))).where("wt > 0")
    scored = test.join(fac, "w").join(weights, ["fold", "factor"])
    return scored.groupBy("fold", "te", "arm", "i", "d", "fwd").agg((F.sum(F.col("f") * F.col("wt")) / F.sum("wt")).alias("s"))


@query("walk_forward_arms", "h_price h_signal h_factor", f"WITH {_WALK}, x AS (SELECT arm, round(s, 9) AS s, fwd FROM sc), y AS (" + SPEARMAN.format(k="arm", x="s", y="fwd", t="x", empty="0")
       + """) SELECT arm, y.n, y.ic, round(avg(CASE WHEN (s >= 50) = (fwd >= 0) THEN 1.0 ELSE 0 END), 6)::DOUBLE AS hit_rate FROM x JOIN y USING (arm) GROUP BY ALL""")
def walk_forward_arms(spark, sf):
    """Fitted, current and equal weights over the pooled test windows of an expanding walk-forward:
    a horizon of rows between training and test, 52 rows a test, folds under five pairs left out."""
    rows = _walk(spark, sf).withColumn("s", F.round("s", 9))
    return X.spearman(rows, "s", "fwd", ["arm"], 0.0, "ic", X.hit_rate("s", "fwd").alias("hit")).select("arm", "n", r6("ic", "ic"), r6("hit", "hit_rate"))


@query("walk_forward_folds", "h_price h_signal h_factor", f"WITH {_WALK}, x AS (SELECT fold, te, d, round(s, 9) AS s, fwd FROM sc WHERE arm = 'fitted'), y AS (" + SPEARMAN.format(k="fold", x="s", y="fwd", t="x", empty="0")
       + """) SELECT y.fold, (SELECT d FROM sn WHERE i = x.te - 1) AS train_to, min(x.d) AS first_test, y.n, y.ic FROM x JOIN y USING (fold) GROUP BY ALL""")
def walk_forward_folds(spark, sf):
    rows = _walk(spark, sf).where("arm = 'fitted'").withColumn("s", F.round("s", 9))
    ics = X.spearman(rows, "s", "fwd", ["fold", "te"], 0.0, "ic", F.min("d").alias("first_test"))
    snaps = h_signal(spark, sf).join(h_price(spark, sf).select("d"), "d").select(F.col("d").alias("train_to"), F.row_number().over(W.orderBy("d")).alias("te"))
    return ics.join(snaps, "te").select("fold", "train_to", "first_test", "n", r6("ic", "ic"))


_GREEDY = """ord AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY outcome_d, d) AS r FROM te),
    gr AS (SELECT fold, r, outcome_d FROM ord WHERE r = 1 UNION ALL SELECT gr.fold, n.r, n.outcome_d FROM gr, LATERAL (SELECT * FROM ord WHERE ord.fold = gr.fold AND ord.r > gr.r AND ord.d >= gr.outcome_d ORDER BY ord.r LIMIT 1) n),"""
_PURGED = f"""RECURSIVE p AS (SELECT *, row_number() OVER (ORDER BY d) - 1 AS i FROM h_pairs), fo AS (SELECT k AS fold, 200 + 52 * k AS lo, min(d) AS test_from FROM p, (SELECT unnest(range((SELECT count(*) // 52 + 1 FROM p))) AS k) WHERE i >= 200 + 52 * k AND i < 252 + 52 * k GROUP BY 1, 2),
    te AS (SELECT fold, p.* FROM fo JOIN p ON i >= lo AND i < lo + 52), {_GREEDY}
    tr AS (SELECT fold, count(*) FILTER (outcome_d >= test_from) AS purged, count(*) FILTER (outcome_d < test_from AND outcome_d >= test_from - 91) AS embargoed, count(*) FILTER (outcome_d < test_from - 91) AS train_n,
        quantile_cont(fwd, 0.1) FILTER (outcome_d < test_from - 91) AS q FROM fo JOIN p ON i < lo GROUP BY 1),
    fm AS (SELECT te.fold, train_n, purged, embargoed, CASE WHEN train_n >= 20 THEN q END AS q10, count(*) AS test_n, (SELECT count(*) FROM gr WHERE gr.fold = te.fold) AS independent_n,
        count(*) FILTER (train_n >= 20 AND fwd <= q) AS tails, count(*) FILTER (target_exposure <= 0.5) AS calls, count(*) FILTER (train_n >= 20 AND fwd <= q AND target_exposure <= 0.5) AS caught FROM te JOIN tr USING (fold) GROUP BY ALL)"""


def purged_fold_metrics_(spark, sf) -> DataFrame:
    pairs = h_pairs(spark, sf).withColumn("i", F.row_number().over(W.orderBy("d")) - 1)
    folds = _folds(pairs.agg(F.count(F.lit(1)).alias("total")), "lo").drop("total")
    test = pairs.join(folds, (F.col("i") >= F.col("lo")) & (F.col("i") < F.col("lo") + P.TEST_PAIRS))
    starts = test.groupBy("fold", "lo").agg(F.min("d").alias("test_from"))
    train = T.purge(pairs.join(F.broadcast(starts), F.col("i") < F.col("lo")), F.col("test_from"))  # a row for each fold
    of = lambda s: F.count_if(F.col("split") == s)
    train = train.groupBy("fold").agg(of("KEPT").alias("train_n"), of("PURGED").alias("purged"), of("EMBARGOED").alias("embargoed"), F.expr("percentile(CASE WHEN split = 'KEPT' THEN fwd END, 0.1D)").alias("q10"))
    train = train.withColumn("q10", F.when(F.col("train_n") >= P.MIN_TAIL, F.col("q10")))
    tail, call = F.coalesce(F.col("fwd") <= F.col("q10"), F.lit(False)), F.col("target_exposure") <= 0.5
    got = test.join(train, "fold").groupBy("fold", "train_n", "purged", "embargoed", "q10").agg(
        F.count(F.lit(1)).alias("test_n"), F.count_if(tail).alias("tails"), F.count_if(call).alias("calls"), F.count_if(tail & call).alias("caught")
    )
    alone = T.earliest_exit_set(test.select("fold", "d", "outcome_d"), ["fold"]).groupBy("fold").agg(F.count(F.lit(1)).alias("independent_n"))
    return got.join(alone, "fold")


@query("purged_fold_metrics", "h_pairs", f"WITH {_PURGED} SELECT fold, CAST(train_n AS BIGINT) AS train_n, CAST(purged AS BIGINT) AS purged, CAST(embargoed AS BIGINT) AS embargoed, round(q10, 6) AS q10, CAST(test_n AS BIGINT) AS test_n, CAST(independent_n AS BIGINT) AS independent_n, CAST(tails AS BIGINT) AS tails, CAST(calls AS BIGINT) AS calls, CAST(caught AS BIGINT) AS caught FROM fm")
def purged_fold_metrics(spark, sf):
    """Each purged fold: training rows kept and dropped, the tail threshold of the training rows, tail counts of the test."""
    return purged_fold_metrics_(spark, sf).withColumn("q10", F.round("q10", 6))


@query("validation_report", "h_pairs", f"""WITH {_PURGED}, ga AS (SELECT d, outcome_d FROM te), po AS (SELECT count(*) AS folds, sum(test_n) AS overlapping, sum(tails) AS tails, sum(calls) AS calls, sum(caught) AS caught, coalesce(bool_and(train_n >= 20), false) AS ready FROM fm)
    SELECT CASE WHEN folds > 0 THEN 'OK' ELSE 'INSUFFICIENT_SAMPLE' END AS status, CAST(folds AS BIGINT) AS folds, CAST(overlapping AS BIGINT) AS overlapping, CAST(tails AS BIGINT) AS tails, CAST(calls AS BIGINT) AS calls, CAST(caught AS BIGINT) AS caught,
        CASE WHEN ready AND tails >= 3 THEN 'OK' ELSE 'INSUFFICIENT_SAMPLE' END AS recall_status, CASE WHEN ready AND tails >= 3 THEN round(caught / tails, 6) END AS recall,
        CASE WHEN ready AND calls >= 3 THEN 'OK' ELSE 'INSUFFICIENT_SAMPLE' END AS precision_status, CASE WHEN ready AND calls >= 3 THEN round(caught / calls, 6) END AS precision_ FROM po""")
def validation_report(spark, sf):
    """Pooled tail counts of the folds with their statuses."""
    total = lambda c: F.sum(c).cast("long").alias(c)
    po = purged_fold_metrics_(spark, sf).agg(
        F.count(F.lit(1)).alias("folds"), F.sum("test_n").cast("long").alias("overlapping"), total("tails"), total("calls"), total("caught"),
        F.coalesce(F.bool_and(F.col("train_n") >= P.MIN_TAIL), F.lit(False)).alias("ready"),
    )
    ok = lambda c: F.coalesce(F.col("ready") & (F.col(c) >= P.MIN_TAIL_EVENTS), F.lit(False))
    status = lambda c: F.when(ok(c), "OK").otherwise("INSUFFICIENT_SAMPLE")
    share = lambda c: F.when(ok(c), F.round(F.try_divide(F.col("caught").cast("double"), F.col(c)), 6))
    return po.select(
        F.when(F.col("folds") > 0, "OK").otherwise("INSUFFICIENT_SAMPLE").alias("status"), "folds", "overlapping", "tails", "calls", "caught",
        status("tails").alias("recall_status"), share("tails").alias("recall"), status("calls").alias("precision_status"), share("calls").alias("precision_"),
    )


_YEAR_FOLDS = [(k + 1, f"{1996 + k}-01-01", f"{1997 + k}-01-01") for k in range(6)]


@query("oos_gate", "h_pairs", f"""
    WITH RECURSIVE o AS (SELECT *, row_number() OVER (ORDER BY d, outcome_d) AS r FROM h_pairs), gr AS (SELECT r, d, outcome_d, score, fwd FROM o WHERE r = 1 UNION ALL SELECT n.r, n.d, n.outcome_d, n.score, n.fwd FROM gr, LATERAL (SELECT * FROM o WHERE o.r > gr.r AND o.d >= gr.outcome_d ORDER BY o.r LIMIT 1) n),
    fo(fold, a, b) AS (VALUES {", ".join(f"({k}, DATE '{a}', DATE '{b}')" for k, a, b in _YEAR_FOLDS)}),
    s AS (SELECT 'all' AS g, score, fwd FROM h_pairs UNION ALL SELECT 'alone', score, fwd FROM gr UNION ALL SELECT 'fold' || fold, score, fwd FROM h_pairs JOIN fo ON d >= a AND d < b),
    i AS (""" + SPEARMAN.format(k="g", x="score", y="fwd", t="s", empty="NULL") + """), x AS (SELECT max(ic) FILTER (g = 'all') AS ic, max(n) FILTER (g = 'all') AS n, max(ic) FILTER (g = 'alone') AS ic_alone, max(n) FILTER (g = 'alone') AS n_alone,
        CAST(count(*) FILTER (g LIKE 'fold%' AND ic > 0) AS BIGINT) AS positive, CAST(count(*) FILTER (g LIKE 'fold%' AND ic < 0) AS BIGINT) AS negative, count(ic) FILTER (g LIKE 'fold%') AS finite FROM i)
    SELECT ic, n, ic_alone, n_alone, positive, round(greatest(positive, negative) / nullif(finite, 0), 6) AS sign_stability,
        CASE WHEN ic_alone > 0 AND positive >= 4 THEN 'IMPROVES' WHEN ic_alone < 0 AND positive <= 2 THEN 'DEGRADES' ELSE 'INCONCLUSIVE' END AS conclusion FROM x""")
def oos_gate(spark, sf):
    """ICs of all and of independent pairs and of fixed folds, with the sign's stability and the conclusion."""
    pairs = h_pairs(spark, sf)
    folds = spark.createDataFrame(_YEAR_FOLDS, "fold int, a string, b string").select("fold", F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    part = lambda df, g: df.select(g.alias("g"), "score", "fwd")
    inside = pairs.join(F.broadcast(folds), (F.col("d") >= F.col("a")) & (F.col("d") < F.col("b")))
    rows = part(pairs, F.lit("all")).unionByName(part(T.chronological_set(pairs, []), F.lit("alone"))).unionByName(part(inside, F.concat(F.lit("fold"), F.col("fold").cast("string"))))
    i = X.spearman(rows, "score", "fwd", ["g"], None).withColumn("ic", F.round("ic", 6))
    of, fold = lambda g, c: F.max(F.when(F.col("g") == g, F.col(c))), F.col("g").startswith("fold")
    x = i.agg(
        of("all", "ic").alias("ic"), of("all", "n").alias("n"), of("alone", "ic").alias("ic_alone"), of("alone", "n").alias("n_alone"),
        F.count_if(fold & (F.col("ic") > 0)).alias("positive"), F.count_if(fold & (F.col("ic") < 0)).alias("negative"), F.count(F.when(fold, F.col("ic"))).alias("finite"),
    )
    conclusion = F.when((F.col("ic_alone") > 0) & (F.col("positive") >= 4), "IMPROVES").when((F.col("ic_alone") < 0) & (F.col("positive") <= 2), "DEGRADES").otherwise("INCONCLUSIVE")
    return x.select("ic", "n", "ic_alone", "n_alone", "positive", r6(F.try_divide(F.greatest("positive", "negative").cast("double"), F.col("finite")), "sign_stability"), conclusion.alias("conclusion"))


_CANDIDATES = """fp AS (SELECT c.factor, c.w, c.f, avg(a.f) AS comp, any_value(p.fwd) AS fwd FROM h_factor c JOIN h_factor a ON a.w = c.w JOIN h_pairs p ON CAST(date_trunc('week', p.d) AS DATE) = c.w GROUP BY 1, 2, 3),
    ca AS (SELECT a.factor, a.w, a.comp, a.fwd, CAST(count(*) FILTER (b.f <= a.f) AS DOUBLE) / count(*) * 100 AS cand FROM fp a JOIN fp b ON b.factor = a.factor AND b.w <= a.w GROUP BY ALL)"""


def candidate_pairs(spark, sf) -> DataFrame:
    """factor, w, comp (mean of all factors), cand (share of the factor's history at most now, in percent), fwd."""
    pairs, f = h_pairs(spark, sf).select(F.date_trunc("week", "d").cast("date").alias("w"), "fwd"), h_factor(spark, sf).select("factor", "w", "f")
    rows = f.join(f.groupBy("w").agg(F.avg("f").alias("comp")), "w").join(pairs, "w")
    rows = N.expanding_share(rows, "f", ["factor"], "w")
    return rows.select("factor", "w", "comp", (F.col("share") * 100).alias("cand"), "fwd")


@query("expanding_candidate", "h_factor h_pairs", f"WITH {_CANDIDATES} SELECT factor, w, round(comp, 6) AS comp, round(cand, 6) AS cand FROM ca")
def expanding_candidate(spark, sf):
    return candidate_pairs(spark, sf).select("factor", "w", r6("comp", "comp"), r6("cand", "cand"))


@query("incremental_ic", "h_factor h_pairs", f"WITH {_CANDIDATES}, s AS (SELECT factor, 'base' AS k, round(comp, 9) AS x, fwd FROM ca UNION ALL SELECT factor, 'with', round((comp * 9 + cand) / 10, 9), fwd FROM ca), t AS (SELECT factor || '|' || k AS g, x, fwd FROM s), i AS ("
       + SPEARMAN.format(k="g", x="x", y="fwd", t="t", empty="0") + """) SELECT split_part(g, '|', 1) AS factor, max(ic) FILTER (g LIKE '%base') AS ic_base, max(ic) FILTER (g LIKE '%with') AS ic_with,
        round(max(ic) FILTER (g LIKE '%with') - max(ic) FILTER (g LIKE '%base'), 6) AS delta FROM i GROUP BY 1""")
def incremental_ic(spark, sf):
    """IC of the composite of nine with and without the candidate as a tenth."""
    rows = candidate_pairs(spark, sf).select("factor", "fwd", F.round("comp", 9).alias("base"), F.round((F.col("comp") * 9 + F.col("cand")) / 10, 9).alias("with"))
    rows = rows.select("factor", "fwd", F.explode(F.create_map(F.lit("base"), "base", F.lit("with"), "with")).alias("k", "x"))
    i = X.spearman(rows, "x", "fwd", ["factor", "k"]).withColumn("ic", F.round("ic", 6))
    of = lambda k: F.max(F.when(F.col("k") == k, F.col("ic")))
    return i.groupBy("factor").agg(of("base").alias("ic_base"), of("with").alias("ic_with"), F.round(of("with") - of("base"), 6).alias("delta"))


# ---------------------------------------------------------------- event backtest and formal gates

#: Sets of inputs: what is wrong with each (a flaw of its rows' columns), and the instant it is judged at.
_CASES = {
    "governed": "2002-01-01", "no_cutoff": None, "early_cutoff": "2001-03-01", "no_record": "2002-01-01", "no_target": "2002-01-01", "other_method": "2002-01-01",
    "no_run": "2002-01-01", "no_activation": "2002-01-01", "late_cash": "2002-01-01", "synthetic": "2002-01-01", "legacy_vix": "2002-01-01", "no_status": "2002-01-01",
}
_KASES = "kases(name, cutoff) AS (VALUES " + ", ".join(f"('{k}', {'CAST(NULL AS TIMESTAMP)' if v is None else f'TIMESTAMP {chr(39)}{v}{chr(39)}'})" for k, v in _CASES.items()) + ")"
_REASONS = """sg AS (SELECT name, cutoff, idx, CASE WHEN name <> 'no_record' OR idx % 50 <> 7 THEN decision_at + INTERVAL 1 HOUR END AS recorded_at, 'run-' || idx AS data_run_id,
        CASE WHEN name <> 'no_target' OR score < 80 THEN target_exposure END AS target_exposure, CASE WHEN name = 'other_method' AND idx % 60 = 9 THEN 'STRATEGY_V0' ELSE 'STRATEGY_V1' END AS methodology FROM kases, h_signal),
    dv AS (SELECT 1 AS kind, d, close AS x FROM h_price UNION ALL SELECT 2, d, v FROM h_vix UNION ALL SELECT 3, d, rate FROM h_rate),
    dl AS (SELECT name, cutoff, kind, d, d + INTERVAL 30 HOUR AS fetched_at, CASE WHEN name <> 'no_run' OR day(d) <> 17 OR kind <> 2 THEN 'run-' || d END AS data_run_id, 'run-' || d AS activation_run_id,
        CASE WHEN name = 'no_activation' AND day(d) = 11 THEN NULL WHEN name = 'late_cash' AND kind = 3 AND d >= DATE '2001-06-01' THEN d + INTERVAL 300 DAY ELSE d + INTERVAL 2 DAY END AS activated_at,
        CASE WHEN name = 'synthetic' AND day(d) = 13 THEN 'SYNTHETIC_BACKFILL' WHEN name = 'legacy_vix' AND kind = 2 AND day(d) = 19 THEN 'LEGACY_NO_PIT' WHEN name <> 'no_status' OR day(d) <> 23 THEN 'PIT_RAW' END AS status FROM kases, dv),
    rs AS (SELECT name, 0 AS part, 0 AS r1, DATE '1970-01-01' AS r2, CASE WHEN cutoff IS NULL THEN 'missing as-of cutoff provenance' END AS reason FROM kases
        UNION ALL SELECT name, 1, idx, DATE '1970-01-01', CASE WHEN recorded_at IS NULL OR data_run_id IS NULL THEN 'missing official signal provenance' WHEN target_exposure IS NULL OR methodology <> 'STRATEGY_V1' THEN 'missing explicit formal portfolio target'
            WHEN recorded_at >= cutoff THEN 'signal not visible strictly before as-of cutoff' END FROM sg
        UNION ALL SELECT name, 2, kind, d, CASE WHEN fetched_at IS NULL OR data_run_id IS NULL OR activation_run_id IS NULL THEN 'missing daily input provenance' WHEN activated_at IS NULL THEN 'missing daily input activation time'
            WHEN activated_at >= cutoff THEN 'daily input not visible strictly before as-of cutoff' WHEN status = 'SYNTHETIC_BACKFILL' THEN 'synthetic backfill is not formal input'
            WHEN status = 'LEGACY_NO_PIT' THEN 'legacy input without PIT provenance' WHEN status IS DISTINCT FROM 'PIT_RAW' THEN 'missing daily input provenance status' END FROM dl),
    is_ AS (SELECT name, reason FROM rs WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY part, r1, r2) = 1)"""


def _issues(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The cases, and the first reason of each that has one."""
    cases = F.broadcast(spark.createDataFrame(list(_CASES.items()), "name string, cutoff string").select("name", F.col("cutoff").cast("timestamp").alias("cutoff")))
    name, day = F.col("name"), F.dayofmonth("d")
    hours = lambda c, n: F.col(c).cast("timestamp") + F.expr(f"INTERVAL {n} HOURS")
    signals = h_signal(spark, sf).crossJoin(cases).select(
        "name", "idx", F.when((name != "no_record") | (F.col("idx") % 50 != 7), hours("decision_at", 1)).alias("recorded_at"), F.concat(F.lit("run-"), "idx").alias("data_run_id"),
        F.when((name != "no_target") | (F.col("score") < 80), F.col("target_exposure")).alias("target_exposure"),
        F.when((name == "other_method") & (F.col("idx") % 60 == 9), "STRATEGY_V0").otherwise("STRATEGY_V1").alias("methodology"),
    )
    daily = h_price(spark, sf).select(F.lit(1).alias("kind"), "d").unionByName(h_vix(spark, sf).select(F.lit(2).alias("kind"), "d")).unionByName(h_rate(spark, sf).select(F.lit(3).alias("kind"), "d"))
    run = F.concat(F.lit("run-"), F.col("d").cast("string"))
    daily = daily.crossJoin(cases).select(
        "name", "kind", "d", hours("d", 30).alias("fetched_at"), F.when((name != "no_run") | (day != 17) | (F.col("kind") != 2), run).alias("data_run_id"), run.alias("activation_run_id"),
        F.when((name == "no_activation") & (day == 11), None).when((name == "late_cash") & (F.col("kind") == 3) & (F.col("d") >= F.lit("2001-06-01").cast("date")), hours("d", 7200)).otherwise(hours("d", 48)).alias("activated_at"),
        F.when((name == "synthetic") & (day == 13), "SYNTHETIC_BACKFILL").when((name == "legacy_vix") & (F.col("kind") == 2) & (day == 19), "LEGACY_NO_PIT")
        .when((name != "no_status") | (day != 23), "PIT_RAW").alias("status"),
    )
    return cases, G.provenance_issues(cases, signals, daily, ["name"], "STRATEGY_V1")


@query("provenance_gate", "h_price h_signal h_rate h_vix", f"WITH {_KASES}, {_REASONS} SELECT name, reason FROM kases LEFT JOIN is_ USING (name)")
def provenance_gate(spark, sf):
    """The first reason, signals before daily rows, why a set of inputs is not formal."""
    cases, issues = _issues(spark, sf)
    return cases.join(issues, "name", "left").select("name", "reason")


_FROM_FIRST = PORTFOLIO.replace("LEFT JOIN x ON x.exec_d = p.d)", "LEFT JOIN x ON x.exec_d = p.d WHERE p.d >= (SELECT min(exec_d) FROM x))").replace("r.rate, v.d AS vd", "r.rate, r.d AS rd, v.d AS vd")


def evaluation_sessions(spark, sf) -> DataFrame:
    """Sessions from the first execution on, with the exposure carried forward: d, close, target."""
    done = scheduled(spark, sf).where("status = 'EXECUTED'").select(F.col("exec_d").alias("d"), F.col("new_exposure").alias("target"))
    first = F.broadcast(done.agg(F.min("d").alias("first")))
    return N.carry_forward(h_price(spark, sf).join(done, "d", "left"), "target", []).crossJoin(first).where("d >= first").drop("first")


_COST = """st AS (SELECT coalesce(bool_and(p IS NULL OR (rd IS NOT NULL AND p - rd <= 4)), false) AS complete FROM j),
    fi AS (SELECT name, coalesce(reason, CASE WHEN NOT complete THEN 'cash rate missing or stale' END) AS reason FROM kases LEFT JOIN is_ USING (name), st), co AS (SELECT j.d, j.target, abs(target - held) * (3 + CASE WHEN vd IS NULL OR d - vd > 4 OR v >= 28 THEN 3 ELSE 0 END) / 10000 AS cost FROM j)"""


@query("event_backtest", "h_price h_signal h_rate h_vix", f"""WITH {_FROM_FIRST}, {_KASES}, {_REASONS}, {_COST},
    r AS (SELECT round(ln(arg_max(nav, d)), 5) AS log_return, CAST(count(*) AS BIGINT) AS sessions FROM n), k AS (SELECT round(sum(cost), 6) AS cost FROM co)
    SELECT name, CASE WHEN reason IS NULL THEN 'OK' ELSE 'DATA_INCOMPLETE' END AS status, reason, CASE WHEN reason IS NULL THEN log_return END AS log_return,
        CASE WHEN reason IS NULL THEN cost END AS trading_cost, CASE WHEN reason IS NULL THEN sessions END AS sessions FROM fi, r, k""")
def event_backtest(spark, sf):
    """Gate, schedule, carried exposure, daily portfolio: a reason takes all numbers away."""
    nav = M.daily_portfolio(evaluation_sessions(spark, sf), h_vix(spark, sf), h_rate(spark, sf), keys=[])
    got = nav.agg(F.round(F.log(F.max_by("nav", "d")), 5).alias("log_return"), r6(F.sum("trade_cost"), "trading_cost"), F.count(F.lit(1)).alias("sessions"), F.bool_and("complete").alias("complete"))
    cases, issues = _issues(spark, sf)
    rows = cases.join(issues, "name", "left").crossJoin(F.broadcast(got))
    reason = F.coalesce("reason", F.when(~F.col("complete"), "cash rate missing or stale"))
    ok = lambda c: F.when(reason.isNull(), F.col(c)).alias(c)
    return rows.select("name", F.when(reason.isNull(), "OK").otherwise("DATA_INCOMPLETE").alias("status"), reason.alias("reason"), ok("log_return"), ok("trading_cost"), ok("sessions"))


#: Metrics ``me`` of the values ``n`` (methodology, d, target, nav).
METRICS = """mr AS (SELECT *, nav / lag(nav, 1, 1.0) OVER o - 1 AS ret, greatest(1, max(nav) OVER (PARTITION BY methodology ORDER BY d ROWS UNBOUNDED PRECEDING)) AS peak, lead(d) OVER o IS NULL AS is_last FROM n WINDOW o AS (PARTITION BY methodology ORDER BY d)),
    mk AS (SELECT *, sum(CASE WHEN nav >= peak THEN 1 ELSE 0 END) OVER (PARTITION BY methodology ORDER BY d ROWS UNBOUNDED PRECEDING) AS spell FROM mr),
    mb AS (SELECT *, sum(CASE WHEN nav < peak THEN 1 ELSE 0 END) OVER (PARTITION BY methodology, spell ORDER BY d ROWS UNBOUNDED PRECEDING) AS below FROM mk),
    me AS (SELECT methodology, round(avg(target) FILTER (NOT is_last), 5) AS average_beta, round(stddev_pop(ret) * sqrt(252), 5) AS volatility, round(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(252), 5) AS sharpe,
        round(avg(ret) / nullif(sqrt(sum(least(ret, 0) * least(ret, 0)) / count(*)), 0) * sqrt(252), 5) AS sortino, round(min(nav / peak - 1), 5) AS max_drawdown, CAST(max(below) AS BIGINT) AS drawdown_sessions FROM mb GROUP BY 1)"""


@query("benchmark_portfolios", "h_price h_signal h_rate h_vix", f"""WITH {SCHEDULE},
    pr AS (SELECT d, close, close / lag(close) OVER (ORDER BY d) - 1 AS ret FROM h_price),
    tg AS (SELECT d, close, count(ret) OVER a AS vn, stddev_pop(ret) OVER a AS sd, count(*) OVER b AS mn, avg(close) OVER b AS ma, lag(close) OVER (ORDER BY d) AS pc FROM pr WINDOW a AS (ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), b AS (ORDER BY d ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)),
    ev AS (SELECT tg.*, coalesce(last_value(x.target_exposure IGNORE NULLS) OVER (ORDER BY tg.d ROWS UNBOUNDED PRECEDING), 0) AS strategy, lead(tg.d) OVER (ORDER BY tg.d) IS NULL AS is_last FROM tg LEFT JOIN x ON x.exec_d = tg.d WHERE tg.d >= (SELECT min(exec_d) FROM x)),
    be AS (SELECT avg(strategy) FILTER (NOT is_last) AS beta FROM ev),
    q AS (SELECT 'strategy' AS methodology, d, close, strategy::DOUBLE AS target FROM ev UNION ALL SELECT 'buy_hold', d, close, 1 FROM ev UNION ALL SELECT 'beta_matched', d, close, beta FROM ev, be
        UNION ALL SELECT 'vol_target', d, close, CASE WHEN vn < 20 OR sd IS NULL THEN 0 WHEN sd = 0 THEN 1 ELSE least(1, 0.1 / (sd * sqrt(252))) END FROM ev UNION ALL SELECT 'moving_average', d, close, CASE WHEN mn = 200 AND pc > ma THEN 1 ELSE 0 END FROM ev),
    s AS (SELECT methodology, d, close, target, lag(d) OVER o AS p, lag(close) OVER o AS pc, lag(target, 1, 0) OVER o AS held FROM q WINDOW o AS (PARTITION BY methodology ORDER BY d)),
    j AS (SELECT s.*, r.rate, v.d AS vd, v.v FROM s ASOF LEFT JOIN h_rate r ON s.p > r.d ASOF LEFT JOIN h_vix v ON s.d >= v.d),
    c AS (SELECT methodology, d, abs(target - held) * (3 + CASE WHEN vd IS NULL OR d - vd > 4 OR v >= 28 THEN 3 ELSE 0 END) / 10000 AS cost, CASE WHEN p IS NULL THEN 1 ELSE 1 + held * (close / pc - 1) + (1 - held) * coalesce(rate, 0) / 100 * (d - p) / 360 END AS g FROM j),
    n AS (SELECT methodology, d, target, cost, product(g * (1 - cost)) OVER (PARTITION BY methodology ORDER BY d ROWS UNBOUNDED PRECEDING) AS nav FROM c JOIN q USING (methodology, d)),
    z AS (SELECT methodology, CAST(count(*) AS BIGINT) AS sessions, round(sum(cost), 6) AS trading_cost, arg_max(nav, d) - 1 AS total FROM n GROUP BY 1),
    {METRICS}
    SELECT z.methodology, sessions, trading_cost, round(ln(total + 1), 5) AS log_return, printf('%.6e', total - (SELECT total FROM z WHERE methodology = 'beta_matched')) AS over_beta_matched,
        average_beta, volatility, sharpe, sortino, max_drawdown, drawdown_sessions FROM z JOIN me USING (methodology)""")
def benchmark_portfolios(spark, sf):
    """The strategy and four benchmarks over the same sessions, the targets of a session known before it."""
    prices = h_price(spark, sf).withColumn("ret", F.col("close") / N.lag("close", 1, []) - 1)
    held = prices.select("d", F.coalesce(N.vol_target("ret", []), F.lit(0.0)).alias("vol_target"), N.ma_control("close", []).alias("moving_average"))
    ev = evaluation_sessions(spark, sf).withColumnRenamed("target", "strategy").join(held, "d")
    last = F.lead("d").over(W.orderBy("d")).isNull()
    beta = ev.withColumn("last", last).agg(F.avg(F.when(~F.col("last"), F.col("strategy"))).alias("beta_matched"))
    ev = ev.crossJoin(F.broadcast(beta)).withColumn("buy_hold", F.lit(1.0))
    names = ["strategy", "buy_hold", "beta_matched", "vol_target", "moving_average"]
    rows = ev.select("d", "close", F.explode(F.array(*[F.struct(F.lit(n).alias("methodology"), F.col(n).cast("double").alias("target")) for n in names])).alias("x")).select("d", "close", "x.*")
    nav = M.daily_portfolio(rows, h_vix(spark, sf), h_rate(spark, sf), keys=["methodology"])
    z = nav.groupBy("methodology").agg(F.count(F.lit(1)).alias("sessions"), r6(F.sum("trade_cost"), "trading_cost"))
    z = z.join(M.portfolio_metrics(nav, keys=["methodology"]), "methodology")
    base = F.max(F.when(F.col("methodology") == "beta_matched", F.col("total_return"))).over(W.partitionBy())  # five rows
    five = lambda *names: [F.round(c, 5).alias(c) for c in names]
    return z.select(
        "methodology", "sessions", "trading_cost", F.round(F.log(F.col("total_return") + 1), 5).alias("log_return"), F.format_string("%.6e", F.col("total_return") - base).alias("over_beta_matched"),
        *five("average_beta", "volatility", "sharpe", "sortino", "max_drawdown"), "drawdown_sessions",
    )


@query("formal_pairs", "h_price h_signal", f"""WITH {SCHEDULE}
    SELECT x.idx, x.exec_d AS entry_d, p.d AS exit_d, x.score, x.verdict, x.target_exposure, round(p.close / x.price - 1, 6) AS fwd FROM x ASOF JOIN h_price p ON p.d >= x.exec_d + 91 WHERE p.d - (x.exec_d + 91) <= 14""")
def formal_pairs(spark, sf):
    """Executed signals with their 13-week outcomes, those that are there in time."""
    prices = h_price(spark, sf)
    done = scheduled(spark, sf).where("status = 'EXECUTED'").join(prices.select(F.col("d").alias("exec_d"), F.col("close").alias("price")), "exec_d")
    got = M.outcomes(done, prices, F.lit("2001-06-01").cast("timestamp"), keys=[], weeks=(13,)).where("status = 'OK'")
    return got.select("idx", F.col("exec_d").alias("entry_d"), "exit_d", "score", "verdict", "target_exposure", r6("total_return", "fwd"))


@query("formal_signal_gate", "h_signal", """
    WITH c AS (SELECT *, TIMESTAMP '2001-06-01' AS cutoff, decision_at + to_minutes(CAST(CASE idx % 37 WHEN 5 THEN 1 ELSE -30 END AS INTEGER)) AS data_cutoff, CASE WHEN idx % 41 <> 8 THEN decision_at + to_minutes(CAST(CASE idx % 43 WHEN 9 THEN -1 ELSE 10 END AS INTEGER)) END AS recorded_at,
        CASE WHEN idx % 29 = 3 THEN 'INVALID' WHEN idx % 31 = 4 THEN 'OTHER_MODEL' WHEN idx < 40 THEN 'LEGACY' ELSE 'GOVERNED' END AS provenance FROM h_signal)
    SELECT idx, CASE WHEN provenance = 'INVALID' THEN 'INCOMPLETE_PROVENANCE' WHEN provenance = 'OTHER_MODEL' THEN 'MODEL_COHORT_MISMATCH' WHEN idx % 47 = 2 THEN 'MISSING_FACTORS' WHEN target_exposure IS NULL OR idx % 53 = 1 THEN 'MISSING_POLICY' WHEN recorded_at IS NULL THEN 'MISSING_CLOCKS'
        WHEN greatest(decision_at, tradable_at, recorded_at, data_cutoff) >= cutoff THEN 'NOT_VISIBLE' WHEN data_cutoff > decision_at OR decision_at > tradable_at OR recorded_at < decision_at THEN 'CLOCK_ORDER' END AS issue FROM c""")
def formal_signal_gate(spark, sf):
    """Why a signal may not enter formal validation; the first of provenance, model, factors, policy, clocks, visibility, order."""
    i = F.col("idx")
    minutes = lambda m: F.make_dt_interval(F.lit(0), F.lit(0), m)
    c = h_signal(spark, sf).withColumn("data_cutoff", F.col("decision_at") + minutes(F.when(i % 37 == 5, 1).otherwise(-30)))
    c = c.withColumn("recorded_at", F.when(i % 41 != 8, F.col("decision_at") + minutes(F.when(i % 43 == 9, -1).otherwise(10))))
    c = c.withColumn("provenance", F.when(i % 29 == 3, "INVALID").when(i % 31 == 4, "OTHER_MODEL").when(i < 40, "LEGACY").otherwise("GOVERNED"))
    late = F.greatest("decision_at", "tradable_at", "recorded_at", "data_cutoff") >= F.lit("2001-06-01").cast("timestamp")
    order = (F.col("data_cutoff") > F.col("decision_at")) | (F.col("decision_at") > F.col("tradable_at")) | (F.col("recorded_at") < F.col("decision_at"))
    issue = (
        F.when(F.col("provenance") == "INVALID", "INCOMPLETE_PROVENANCE").when(F.col("provenance") == "OTHER_MODEL", "MODEL_COHORT_MISMATCH").when(i % 47 == 2, "MISSING_FACTORS")
        .when(F.col("target_exposure").isNull() | (i % 53 == 1), "MISSING_POLICY").when(F.col("recorded_at").isNull(), "MISSING_CLOCKS").when(late, "NOT_VISIBLE").when(order, "CLOCK_ORDER")
    )
    return c.select("idx", issue.alias("issue"))


# ---------------------------------------------------------------- dual horizon

_TACTICAL = """a AS (SELECT d, v / 1000 AS v FROM h_week WHERE series_id = '1-URGENT'),
    f AS (SELECT a.d, a.v - t.v / 1000 - r.v / 1000 AS level, a.d - t.d <= 3 AND a.d - r.d <= 2 AS fresh FROM a ASOF LEFT JOIN (SELECT * FROM h_obs WHERE series_id = '2-HIGH') t ON a.d >= t.d ASOF LEFT JOIN (SELECT * FROM h_obs WHERE series_id = '3-MEDIUM') r ON a.d >= r.d),
    g AS (SELECT *, d - lag(d) OVER (ORDER BY d) AS gap FROM f),
    l AS (SELECT d, level, count(*) OVER five AS n, coalesce(bool_and(coalesce(fresh, false)) OVER five, false) AS all_fresh, coalesce(bool_and(gap BETWEEN 5 AND 10) OVER four, false) AS cadence, level - first_value(level) OVER five AS slope, avg(level) OVER four AS ma FROM g
        WINDOW five AS (ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), four AS (ORDER BY d ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
    tl AS (SELECT *, n = 5 AND all_fresh AND cadence AS ok FROM l),
    ts AS (SELECT *, CASE WHEN ok THEN greatest(0, least(100, 0.5 * CASE WHEN level > ma THEN 60 ELSE 40 END + 0.5 * greatest(0, least(100, (slope + 200) / 4)))) END AS trend FROM tl)"""


def tactical_levels_(spark, sf) -> DataFrame:
    """d, level, ok, trend: the last five anchors, each with fresh other series, 5 to 10 days apart."""
    obs = h_obs(spark, sf)
    pick = lambda s: obs.where(F.col("series_id") == s).select("d", "v")
    a = h_week(spark, sf).where("series_id = '1-URGENT'").select("d", (F.col("v") / 1000).alias("v"))
    a = A.asof_last(A.asof_last(a, pick("2-HIGH"), keys=[], carry=["v"], prefix="t_"), pick("3-MEDIUM"), keys=[], carry=["v"], prefix="r_")
    fresh = F.coalesce((F.datediff("d", "t_date") <= 3) & (F.datediff("d", "r_date") <= 2), F.lit(False))
    order = W.orderBy("d")  # one row for each week
    g = a.select("d", (F.col("v") - F.col("t_v") / 1000 - F.col("r_v") / 1000).alias("level"), fresh.alias("fresh"), F.datediff("d", F.lag("d").over(order)).alias("gap"))
    five, four = order.rowsBetween(-4, 0), order.rowsBetween(-3, 0)
    every = lambda c, w: F.coalesce(F.min(c.cast("int")).over(w) == 1, F.lit(False))
    ok = (F.count(F.lit(1)).over(five) == 5) & every(F.col("fresh"), five) & every(F.col("gap").between(5, 10), four)
    back = F.first("level").over(five)
    rows = g.select("d", "level", ok.alias("ok"), back.alias("back"), F.avg("level").over(four).alias("ma"))
    return rows.select("d", "level", "ok", F.when(F.col("ok"), C.trend_score("level", "ma", "back", F.lit(0.0))).alias("trend"))


@query("tactical_levels", "h_obs h_week", f"WITH {_TACTICAL} SELECT d, round(level, 6) AS level, ok, round(trend, 6)::DOUBLE AS trend FROM ts")
def tactical_levels(spark, sf):
    """The four-week trend of fresh weekly levels; none where a level is stale or the cadence breaks."""
    return tactical_levels_(spark, sf).select("d", r6("level", "level"), "ok", r6("trend", "trend"))


_DUAL = f"""{_TACTICAL}, fs AS (SELECT w, max(f) FILTER (factor = '2-HIGH') AS b, max(f) FILTER (factor = '3-MEDIUM') AS c, max(f) FILTER (factor = '4-NOT SPECIFIED') AS e, max(f) FILTER (factor = '5-LOW' AND day(w) % 9 <> 4) AS g FROM h_factor GROUP BY 1),
    sd AS (SELECT s.idx, s.d, s.score AS strategic, s.target_exposure AS base, CASE WHEN idx % 23 = 6 THEN 'BROKEN' ELSE s.verdict END AS verdict, idx % 31 = 7 AS shifted, idx % 17 = 5 AS no_smooth, ['HIGH','LOW','TRANSITION'][idx % 3 + 1] AS agreement, 30 + idx % 60 AS confidence, fs.*, ts.ok, ts.trend
        FROM h_signal s LEFT JOIN fs ON fs.w = CAST(date_trunc('week', s.d) AS DATE) ASOF LEFT JOIN ts ON s.d >= ts.d),
    st AS (SELECT *, CASE WHEN shifted THEN 'AS_OF_CUTOFF_MISMATCH' WHEN verdict NOT IN ('BULLISH','NEUTRAL','BEARISH') THEN 'FORMAL_SNAPSHOT_INVALID' WHEN b IS NULL OR c IS NULL OR e IS NULL OR g IS NULL THEN 'MISSING_FORMAL_FACTOR_COHORT'
        WHEN no_smooth THEN 'MISSING_RAW_SMOOTH_HISTORY' WHEN NOT coalesce(ok, false) THEN 'MISSING_TACTICAL_HISTORY' END AS issue, greatest(0, least(100, 0.5 * trend + 0.2 * b + 0.15 * c + 0.1 * e + 0.05 * g)) AS tactical FROM sd)"""


@query("dual_horizon_composition", "h_obs h_week h_factor h_signal", f"""WITH {_DUAL}, sh AS (SELECT *, CASE WHEN tactical >= 60 THEN 0.1 WHEN tactical <= 40 THEN -0.1 ELSE 0 END AS raw FROM st),
    ad AS (SELECT *, greatest(0.25, least(1, base + CASE WHEN raw > 0 AND confidence < 60 THEN 0 ELSE raw END)) AS moved FROM sh)
    SELECT idx, CASE WHEN issue IS NULL THEN 'OK' ELSE 'DATA_INCOMPLETE' END AS status, CASE WHEN issue IS NULL THEN round(tactical, 6) END::DOUBLE AS tactical_score,
        CASE WHEN issue IS NULL THEN round(CASE WHEN confidence < 40 THEN least(moved, 0.75) ELSE moved END, 6) END::DOUBLE AS exposure,
        CASE WHEN issue IS NOT NULL THEN issue ELSE CASE WHEN tactical >= 60 THEN 'TACTICAL_UP' WHEN tactical <= 40 THEN 'TACTICAL_DOWN' ELSE 'TACTICAL_NEUTRAL' END
            || CASE WHEN raw > 0 AND confidence < 60 THEN ',UPWARD_ADJUSTMENT_BLOCKED_LOW_CONFIDENCE' ELSE '' END || CASE WHEN confidence < 40 THEN ',LOW_CONFIDENCE_EXPOSURE_CAP' ELSE '' END || ',RAW_SMOOTH_' || agreement END AS reasons FROM ad""")
def dual_horizon_composition(spark, sf):
    """The ladder of reasons why there is no second horizon, and else its score, exposure and reasons."""
    i, day = F.col("idx"), F.dayofmonth("w")
    of = lambda k, more=F.lit(True): F.max(F.when((F.col("factor") == k) & more, F.col("f")))
    fs = h_factor(spark, sf).groupBy("w").agg(of("2-HIGH").alias("b"), of("3-MEDIUM").alias("c"), of("4-NOT SPECIFIED").alias("e"), of("5-LOW", day % 9 != 4).alias("g"))
    s = h_signal(spark, sf).select("idx", "d", F.col("target_exposure").alias("base"), F.when(i % 23 == 6, "BROKEN").otherwise(F.col("verdict")).alias("verdict"), (30 + i % 60).alias("confidence"), F.date_trunc("week", "d").cast("date").alias("w"))
    s = A.asof_last(s.join(fs, "w", "left"), tactical_levels_(spark, sf), keys=[], carry=["ok", "trend"], prefix="t_")
    issue = (
        F.when(i % 31 == 7, "AS_OF_CUTOFF_MISMATCH").when(~F.col("verdict").isin("BULLISH", "NEUTRAL", "BEARISH"), "FORMAL_SNAPSHOT_INVALID")
        .when(F.col("b").isNull() | F.col("c").isNull() | F.col("e").isNull() | F.col("g").isNull(), "MISSING_FORMAL_FACTOR_COHORT")
        .when(i % 17 == 5, "MISSING_RAW_SMOOTH_HISTORY").when(~F.coalesce("t_ok", F.lit(False)), "MISSING_TACTICAL_HISTORY")
    )
    tactical = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("t_trend") * 0.5 + F.col("b") * 0.2 + F.col("c") * 0.15 + F.col("e") * 0.1 + F.col("g") * 0.05))
    x = s.select("idx", "base", "confidence", issue.alias("issue"), tactical.alias("tactical"), cycle(["HIGH", "LOW", "TRANSITION"]).alias("agreement"))
    t, c = F.col("tactical"), F.col("confidence")
    reason = F.concat_ws(
        ",", F.when(t >= 60, "TACTICAL_UP").when(t <= 40, "TACTICAL_DOWN").otherwise("TACTICAL_NEUTRAL"), F.when((t >= 60) & (c < 60), "UPWARD_ADJUSTMENT_BLOCKED_LOW_CONFIDENCE"),
        F.when(c < 40, "LOW_CONFIDENCE_EXPOSURE_CAP"), F.concat(F.lit("RAW_SMOOTH_"), "agreement"),
    )
    ok = lambda v, n: F.when(F.col("issue").isNull(), F.round(v, 6)).alias(n)
    return x.select("idx", F.when(F.col("issue").isNull(), "OK").otherwise("DATA_INCOMPLETE").alias("status"), ok(t, "tactical_score"), ok(C.shadow_exposure("base", t, c), "exposure"), F.coalesce("issue", reason).alias("reasons"))


@query("factor_results", "h_obs h_signal", """
    WITH x AS (SELECT s.idx, s.d, s.score, a.d AS ad, b.d AS bd FROM h_signal s ASOF LEFT JOIN (SELECT d FROM h_obs WHERE series_id = '1-URGENT' AND d >= DATE '1995-06-01') a ON s.d >= a.d ASOF LEFT JOIN (SELECT d FROM h_obs WHERE series_id = '2-HIGH' AND day(d) < 20) b ON s.d >= b.d),
    y AS (SELECT *, CASE WHEN ad IS NULL OR bd IS NULL THEN 'MISSING' WHEN d - ad > 3 OR d - bd > 7 THEN 'STALE' WHEN idx % 13 = 4 THEN 'MISSING' END AS bad FROM x)
    SELECT idx, coalesce(bad, CASE WHEN idx % 5 = 2 THEN 'PARTIAL' ELSE 'OK' END) AS status, CASE WHEN bad IS NULL THEN score END AS score, CASE WHEN bad IS NOT NULL THEN 0 WHEN idx % 5 = 2 THEN 0.5 ELSE 1 END::DOUBLE AS quality,
        CASE WHEN ad IS NOT NULL AND bd IS NOT NULL THEN least(ad, bd) END AS as_of FROM y""")
def factor_results(spark, sf):
    """A factor of two series: missing beats stale beats unusable history; the oldest date, none if one is missing."""
    i, obs = F.col("idx"), h_obs(spark, sf)
    x = A.asof_last(h_signal(spark, sf).select("idx", "d", "score"), obs.where("series_id = '1-URGENT' and d >= date'1995-06-01'").select("d", "v"), keys=[], carry=["v"], prefix="a_")
    x = A.asof_last(x, obs.where("series_id = '2-HIGH' and day(d) < 20").select("d", "v"), keys=[], carry=["v"], prefix="b_")
    none = F.col("a_date").isNull() | F.col("b_date").isNull()
    bad = F.when(none, "MISSING").when((F.datediff("d", "a_date") > 3) | (F.datediff("d", "b_date") > 7), "STALE").when(i % 13 == 4, "MISSING")
    good = F.when(i % 5 == 2, "PARTIAL").otherwise("OK")
    quality = F.when(bad.isNotNull(), 0.0).when(i % 5 == 2, 0.5).otherwise(1.0)
    return x.select("idx", F.coalesce(bad, good).alias("status"), F.when(bad.isNull(), F.col("score")).alias("score"), quality.alias("quality"), F.when(~none, F.least("a_date", "b_date")).alias("as_of"))


# ---------------------------------------------------------------- sources and answers


@query("backtest_rows", "h_signal h_price", "SELECT s.d, score, p.close FROM h_signal s JOIN h_price p USING (d) WHERE idx % 7 <> 0 AND p.close IS NOT NULL")
def backtest_rows(spark, sf):
    """Rows of status OK that have a price."""
    return h_signal(spark, sf).where("idx % 7 <> 0").join(h_price(spark, sf), "d").where("close is not null").select("d", "score", "close")


@query("release_rule_issues", "", """
    WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 5 THEN '1997-02-30' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS f, CASE WHEN l_linenumber <> 3 THEN strftime(l_shipdate + to_days(CAST(14 - l_linenumber * 4 AS INTEGER)), '%Y-%m-%d') END AS t FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN try_cast(f AS DATE) IS NULL OR (t IS NOT NULL AND try_cast(t AS DATE) IS NULL) THEN 'invalid date' WHEN try_cast(t AS DATE) < try_cast(f AS DATE) THEN 'from after to' END AS issue FROM x""")
def release_rule_issues(spark, sf):
    """Release rules with a date that does not exist, or that end before they begin; an open end is right."""
    n, text = F.col("l_linenumber"), lambda c: F.date_format(c, "yyyy-MM-dd")
    end = F.when(n != 3, text(F.expr("date_add(to_date(l_shipdate), cast(14 - l_linenumber * 4 as int))")))
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(n == 5, "1997-02-30").otherwise(text("l_shipdate")).alias("f"), end.alias("t"))
    f, t = strict_date(F.col("f")), strict_date(F.col("t"))
    issue = F.when(f.isNull() | (F.col("t").isNotNull() & t.isNull()), "invalid date").when(t < f, "from after to")
    return x.select("l_orderkey", "l_linenumber", issue.alias("issue"))


@query("vintage_windows", "h_pit", """
    WITH b AS (SELECT series_id, min(vintage_date) AS a, max(vintage_date) AS z FROM h_pit GROUP BY 1), w AS (SELECT series_id, k, a + CAST(k * 2000 AS INTEGER) AS f, least(z, a + CAST(k * 2000 + 1999 AS INTEGER)) AS t FROM (SELECT *, unnest(range((z - a) // 2000 + 1)) AS k FROM b))
    SELECT w.series_id, f AS window_from, t AS window_to, CAST(count(p.value) AS BIGINT) AS n, CAST(ceil(count(p.value) / 1000) AS BIGINT) AS pages FROM w LEFT JOIN h_pit p ON p.series_id = w.series_id AND p.vintage_date BETWEEN f AND t GROUP BY 1, 2, 3""")
def vintage_windows(spark, sf):
    """A series' vintages cut into windows of 2,000 days, with the pages of 1,000 rows that each takes."""
    pit = h_pit(spark, sf).select("series_id", "vintage_date")
    b = pit.groupBy("series_id").agg(F.min("vintage_date").alias("a"), F.max("vintage_date").alias("z"))
    w = b.select("series_id", F.col("a"), "z", F.explode(F.sequence(F.lit(0), F.floor(F.datediff("z", "a") / 2000).cast("int"))).alias("k"))
    # every vintage lies in one window, so its number is computed and not searched
    own = pit.join(b.drop("z"), "series_id").groupBy("series_id", F.floor(F.datediff("vintage_date", "a") / 2000).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    got = w.join(own, ["series_id", "k"], "left")
    start = F.expr("date_add(a, k * 2000)")
    return got.select("series_id", start.alias("window_from"), F.least("z", F.date_add(start, 1999)).alias("window_to"), n.alias("n"), F.ceil(n / 1000).cast("long").alias("pages"))


@query("latest_vintage_conflicts", "", """
    SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS obs_date, CAST(o_orderdate AS DATE) + CAST(l_linenumber AS INTEGER) AS vintage_date, CAST(count(DISTINCT l_extendedprice) AS BIGINT) AS n_values
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3 HAVING count(DISTINCT l_extendedprice) > 1""")
def latest_vintage_conflicts(spark, sf):
    """Pages of one fetch may repeat a row but not change it."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("obs_date"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("vintage_date", F.expr("date_add(obs_date, l_linenumber)"))
    return T.conflicts(rows, ["series_id", "obs_date", "vintage_date"], "l_extendedprice")


@query("fallback_source", "h_obs", """
    WITH a AS (SELECT d, v FROM h_obs WHERE series_id = '2-HIGH' AND day(d) % 3 <> 0), b AS (SELECT d, v FROM h_obs WHERE series_id = '3-MEDIUM')
    SELECT coalesce(a.d, b.d) AS d, coalesce(a.v, b.v) AS v, CASE WHEN a.d IS NULL THEN 'fallback' ELSE 'primary' END AS source FROM a FULL JOIN b ON a.d = b.d""")
def fallback_source(spark, sf):
    """Each day from the first source that has it."""
    obs = h_obs(spark, sf)
    a = obs.where("series_id = '2-HIGH' and day(d) % 3 <> 0").select("d", F.col("v").alias("p"))
    b = obs.where("series_id = '3-MEDIUM'").select("d", F.col("v").alias("q"))
    return a.join(b, "d", "full").select("d", F.coalesce("p", "q").alias("v"), F.when(F.col("p").isNull(), "fallback").otherwise("primary").alias("source"))


@query("snapshot_envelopes", "h_signal", "SELECT d, score, idx FROM h_signal WHERE d >= DATE '1996-01-01'")
def snapshot_envelopes(spark, sf):
    """Snapshots from JSON of three shapes: a list, a list under ``snapshots`` or under ``data``; from 1996 on."""
    row = F.to_json(F.array(F.struct(F.date_format("d", "yyyy-MM-dd").alias("date"), "score", "idx")))
    kind = F.col("idx") % 3
    body = F.when(kind == 0, row).when(kind == 1, F.concat(F.lit('{"snapshots":'), row, F.lit("}"))).otherwise(F.concat(F.lit('{"data":'), row, F.lit("}")))
    texts = h_signal(spark, sf).select(body.alias("body"))
    rows = texts.select(F.explode(snapshot_rows(F.col("body"))).alias("s")).select(F.to_date("s.date").alias("d"), "s.score", "s.idx")
    return rows.where("d >= date'1996-01-01'")


def snapshot_rows(body: Column) -> Column:
    item = "array<struct<date:string,score:double,idx:bigint>>"
    held = F.from_json(body, f"struct<snapshots:{item},data:{item}>")
    return F.when(F.ltrim(body).startswith("["), F.from_json(body, item)).otherwise(F.coalesce(held["snapshots"], held["data"]))


@query("json_answers", "", """SELECT n_nationkey, '{"id":' || n_nationkey || ',"name":"' || n_name || '","region":' || n_regionkey || '}' AS body, CASE WHEN n_nationkey % 6 = 5 THEN 404 ELSE 200 END AS status FROM nation""")
def json_answers(spark, sf):
    k = F.col("n_nationkey")
    body = F.to_json(F.struct(k.alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    return table(spark, sf, "nation").select("n_nationkey", body.alias("body"), F.when(k % 6 == 5, 404).otherwise(200).alias("status"))


@query("audit_rows", "", """
    SELECT event_id, event_type AS action, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'OK' END AS outcome, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision FROM events""")
def audit_rows(spark, sf):
    """What was done, appended in the order of each actor."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    outcome = F.when(F.col("event_type") == "error", "FAILED").otherwise("OK")
    return table(spark, sf, "events").select("event_id", F.col("event_type").alias("action"), outcome.alias("outcome"), F.row_number().over(order).cast("long").alias("revision"))


@query("work_limits", "", """
    SELECT user_id, CASE WHEN count(*) > 12 THEN 'WORK_LIMIT_EXCEEDED' ELSE 'OK' END AS status, CASE WHEN count(*) <= 12 THEN CAST(count(*) AS BIGINT) END AS n FROM events GROUP BY 1""")
def work_limits(spark, sf):
    """A request of more rows than its limit is refused whole, not cut."""
    n = F.count(F.lit(1))
    return table(spark, sf, "events").groupBy("user_id").agg(F.when(n > 12, "WORK_LIMIT_EXCEEDED").otherwise("OK").alias("status"), F.when(n <= 12, n).alias("n"))


_ERAS = [("early", "1995-01-01", "1997-01-01"), ("middle", "1997-01-01", "1999-01-01"), ("late", "1999-01-01", "2003-01-01")]


@query("lead_scan_eras", "h_week h_price", f"""
    WITH er(era, a, b) AS (VALUES {", ".join(f"('{e}', DATE '{a}', DATE '{b}')" for e, a, b in _ERAS)}), z AS (SELECT max(d) AS last FROM h_price),
    g AS (SELECT a.series_id, a.w, a.v / nullif(b.v, 0) - 1 AS growth FROM h_week a JOIN h_week b ON b.series_id = a.series_id AND b.w = a.w - 91),
    p AS (SELECT g.series_id || '|' || era || '|' || lead AS g, growth, y.close / x.close - 1 AS fwd FROM (SELECT g.*, era, lead FROM g JOIN er ON w >= a AND w < b, (SELECT i AS lead FROM range(0, 27, 2) t(i))) g
        ASOF JOIN h_price x ON x.d <= g.w + CAST(7 * lead AS INTEGER) ASOF JOIN h_price y ON y.d <= g.w + CAST(7 * lead AS INTEGER) + 91 WHERE g.w + CAST(7 * lead AS INTEGER) + 91 <= (SELECT last FROM z)),
    i AS (""" + SPEARMAN.format(k="g", x="growth", y="fwd", t="p", empty="0") + """) SELECT split_part(g, '|', 1) AS series_id, split_part(g, '|', 2) AS era, CAST(split_part(g, '|', 3) AS BIGINT) AS lead, n, ic FROM i""")
def lead_scan_eras(spark, sf):
    """Lead of every series over prices, in weeks, by era; outcomes after the last price count for none."""
    week, prices = h_week(spark, sf), h_price(spark, sf)
    old = week.select("series_id", F.date_add("w", 91).alias("w"), F.col("v").alias("b"))
    eras = F.broadcast(spark.createDataFrame(_ERAS, "era string, a string, z string").select("era", F.to_date("a").alias("a"), F.to_date("z").alias("z")))
    rows = week.join(old, ["series_id", "w"]).select("series_id", "w", (F.try_divide("v", "b") - 1).alias("growth")).join(eras, (F.col("w") >= F.col("a")) & (F.col("w") < F.col("z")))
    rows = rows.withColumn("lead", F.explode(F.sequence(F.lit(0), F.lit(26), F.lit(2)))).withColumn("t0", F.expr("date_add(w, 7 * lead)")).withColumn("t1", F.date_add("t0", 91))
    rows = rows.crossJoin(F.broadcast(prices.agg(F.max("d").alias("last")))).where("t1 <= last")
    day = lambda df, on, p: df.join(A.asof_last(df.select(on).distinct(), prices, keys=[], on=on, data_on="d", carry=["close"], prefix=p), on)
    rows = day(day(rows, "t0", "x_"), "t1", "y_").where("x_close is not null").withColumn("fwd", F.col("y_close") / F.col("x_close") - 1)
    return X.spearman(rows, "growth", "fwd", ["series_id", "era", "lead"]).select("series_id", "era", F.col("lead").cast("long").alias("lead"), "n", r6("ic", "ic"))


@query("fx_neutral_growth", "h_week", """
    WITH g AS (SELECT a.w, a.series_id, a.v, a.v / b.v - 1 AS growth FROM h_week a JOIN h_week b ON b.series_id = a.series_id AND b.w = a.w - 91 WHERE b.v <> 0)
    SELECT w, round(sum(v * growth) / sum(v), 6) AS growth FROM g WHERE series_id < '4' GROUP BY w HAVING count(*) = 3""")
def fx_neutral_growth(spark, sf):
    """Growth over 13 weeks of three balance sheets in their own currencies, weighted by size; all three or none."""
    week = h_week(spark, sf).where("series_id < '4'")
    old = week.select("series_id", F.date_add("w", 91).alias("w"), F.col("v").alias("b"))
    g = week.join(old, ["series_id", "w"]).where("b <> 0").withColumn("growth", F.col("v") / F.col("b") - 1)
    got = g.groupBy("w").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.col("v") * F.col("growth")) / F.sum("v"), "growth"))
    return got.where("n = 3").select("w", "growth")


@query("history_divergence", "", """
    WITH q AS (SELECT user_id, event_type AS provider, CAST(ts AS DATE) AS d, avg(value) AS v FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2, 3), l AS (SELECT user_id, provider, max(d) AS d, arg_max(v, d) AS v FROM q GROUP BY 1, 2)
    SELECT a.user_id, CASE WHEN a.d <> b.d THEN 'DATES_DIFFER' WHEN abs(a.v - b.v) / greatest(abs(a.v), abs(b.v), 1e-9) > 0.25 THEN 'LEVELS_DIFFER' ELSE 'AGREE' END AS verdict FROM l a JOIN l b ON a.user_id = b.user_id WHERE a.provider = 'click' AND b.provider = 'view'""")
def history_divergence(spark, sf):
    """Whether two providers' histories end on one day and at one level."""
    q = table(spark, sf, "events").where("event_type in ('click', 'view')").groupBy("user_id", F.col("event_type").alias("provider"), F.to_date("ts").alias("d")).agg(F.avg("value").alias("v"))
    of = lambda p: F.max(F.when(F.col("provider") == p, F.struct("d", "v")))
    x = q.groupBy("user_id").agg(of("click").alias("a"), of("view").alias("b")).where("a is not null and b is not null")
    gap = F.abs(F.col("a.v") - F.col("b.v")) / F.greatest(F.abs("a.v"), F.abs("b.v"), F.lit(1e-9))
    return x.select("user_id", F.when(F.col("a.d") != F.col("b.d"), "DATES_DIFFER").when(gap > 0.25, "LEVELS_DIFFER").otherwise("AGREE").alias("verdict"))


@query("presented_snapshots", "h_signal", """
    WITH s AS (SELECT *, ['NORMAL','STRESSED','UNKNOWN'][idx % 3 + 1] AS stress, idx % 8 = 3 AS broken FROM h_signal)
    SELECT idx, score, CASE WHEN broken OR stress = 'UNKNOWN' THEN 'UNKNOWN' WHEN stress = 'STRESSED' AND score < 65 THEN CASE verdict WHEN 'BULLISH' THEN 'NEUTRAL' ELSE 'BEARISH' END ELSE verdict END AS display_verdict, CASE WHEN NOT broken THEN stress END AS stress FROM s""")
def presented_snapshots(spark, sf):
    """The stored JSON of a snapshot parsed and its display state computed again; broken JSON shows UNKNOWN."""
    s = h_signal(spark, sf).withColumn("stored", F.when(F.col("idx") % 8 == 3, "{broken").otherwise(F.to_json(F.struct(cycle(["NORMAL", "STRESSED", "UNKNOWN"]).alias("stress")))))
    s = s.withColumn("stress", F.from_json("stored", "struct<stress:string>")["stress"])
    known = F.coalesce("stress", F.lit("UNKNOWN"))
    return s.select("idx", "score", C.display_verdict("verdict", "score", known, F.lit("OK")).alias("display_verdict"), "stress")


@query("merge_asof_buffer", "h_week", """
    WITH t AS (SELECT w, v, row_number() OVER (ORDER BY w) AS n FROM h_week WHERE series_id = '2-HIGH'), r AS (SELECT w, v FROM h_week WHERE series_id = '3-MEDIUM'), a AS (SELECT t.w, t.v, r.v AS buffer FROM t ASOF LEFT JOIN r ON t.w >= r.w)
    SELECT w, CASE WHEN count(*) OVER p = 0 THEN 'NO_HISTORY' WHEN bool_or(buffer IS NULL) OVER p THEN 'MISSING_ALIGNMENT' ELSE 'OK' END AS status, round(avg(buffer) OVER p, 6) AS mean_buffer, CAST(count(*) OVER p AS BIGINT) AS n FROM a WINDOW p AS (ORDER BY w ROWS BETWEEN 157 PRECEDING AND 1 PRECEDING)""")
def merge_asof_buffer(spark, sf):
    """Of up to 157 strictly earlier anchors, each with the other series as of it; an anchor without one is an error."""
    week = h_week(spark, sf)
    t = week.where("series_id = '2-HIGH'").select("w")
    a = A.asof_last(t, week.where("series_id = '3-MEDIUM'").select("w", "v"), keys=[], on="w", data_on="w", carry=["v"], prefix="r_")
    p = W.orderBy("w").rowsBetween(-157, -1)  # one row for each week
    n = F.count(F.lit(1)).over(p)
    status = F.when(n == 0, "NO_HISTORY").when(F.count("r_v").over(p) < n, "MISSING_ALIGNMENT").otherwise("OK")
    return a.select("w", status.alias("status"), r6(F.avg("r_v").over(p), "mean_buffer"), n.alias("n"))


@query("frozen_pages", "h_signal h_price", """
    SELECT d, count(*)::BIGINT AS n FROM (SELECT d FROM h_signal WHERE idx % 2 = 0 UNION ALL SELECT d FROM h_price WHERE day(d) < 4) GROUP BY 1""")
def frozen_pages(spark, sf):
    """Weekly and daily frozen days together, each kept as often as it is named."""
    both = h_signal(spark, sf).where("idx % 2 = 0").select("d").unionByName(h_price(spark, sf).where("day(d) < 4").select("d"))
    return both.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
