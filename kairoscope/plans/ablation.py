"""Queries: the model without some of its factors, from the score to the portfolio, all arms in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import params as P
from ..functions import scores as C
from ..operators import asof as A
from ..operators import sets as T
from ..operators import simulate as M
from ..operators import stats as X
from ..operators import windows as N
from .evaluation import SPEARMAN
from .flows import METRICS
from .harness import h_factor, h_price, h_rate, h_signal, h_vix, query, r6

WEIGHTS = {"1-URGENT": 0.35, "2-HIGH": 0.18, "3-MEDIUM": 0.15, "4-NOT SPECIFIED": 0.06, "5-LOW": 0.04}
ARMS = {"full": [], "no_credit": ["4-NOT SPECIFIED"], "no_funding": ["5-LOW"], "neither": ["4-NOT SPECIFIED", "5-LOW"]}
HORIZONS = (4, 8, 13)
CUTOFF = "2001-06-01"


def arm_signals(spark, sf) -> DataFrame:
    """Decisions that have all factors, for each arm: rescored, judged in decision order with the band kept, and mapped to an exposure."""
    weights = F.broadcast(spark.createDataFrame(list(WEIGHTS.items()), "factor string, wt double"))
    arms = F.broadcast(spark.createDataFrame(list(ARMS.items()), "arm string, dropped array<string>"))
    rows = h_factor(spark, sf).join(weights, "factor").crossJoin(arms).withColumn("wt", F.when(~F.array_contains("dropped", F.col("factor")), F.col("wt")))
    scored = rows.groupBy("arm", "w").agg(r6(F.sum(F.col("f") * F.col("wt")) / F.sum("wt"), "score"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(WEIGHTS))
    s = h_signal(spark, sf).select("idx", "d", F.date_trunc("week", "d").cast("date").alias("w"), "decision_at", "tradable_at").join(h_price(spark, sf), "d")
    s = s.withColumn("dir", C.direction("close", N.sma("close", P.TREND_WEEKS, [], "d"))).drop("close")  # a row a week
    s = A.asof_last(s, h_vix(spark, sf), keys=[], carry=["v"], prefix="x_")
    s = s.withColumn("stress", C.vix_stress(F.when(F.datediff("d", "x_date") <= P.VIX_STALE_DAYS, F.col("x_v"))))
    s = s.join(scored.drop("n"), "w").withColumn("verdict", N.hysteresis(C.band("score"), ["arm"], "decision_at"))
    return s.select("arm", "idx", "d", "decision_at", "tradable_at", "score", "verdict", C.exposure("verdict", "dir", "score", "stress").alias("target_exposure"))


def _prices(spark, sf) -> DataFrame:
    return h_price(spark, sf).withColumn("arm", F.explode(F.array(*[F.lit(a) for a in ARMS])))


def _scheduled(spark, sf) -> DataFrame:
    return M.schedule(arm_signals(spark, sf), _prices(spark, sf), keys=["arm"])


_SIGNALS = f"""weights(factor, wt) AS (VALUES {", ".join(f"('{f}', {w})" for f, w in WEIGHTS.items())}), arms(arm) AS (VALUES {", ".join(f"('{a}')" for a in ARMS)}),
    sc AS (SELECT arm, w, round(sum(f * wt) FILTER (kept) / sum(wt) FILTER (kept), 6) AS score FROM (SELECT arm, w, factor, f, wt,
        NOT (arm IN ('no_credit', 'neither') AND factor = '4-NOT SPECIFIED') AND NOT (arm IN ('no_funding', 'neither') AND factor = '5-LOW') AS kept FROM h_factor JOIN weights USING (factor) CROSS JOIN arms) GROUP BY 1, 2 HAVING count(*) = 5),
    sm AS (SELECT s.idx, s.d, s.decision_at, s.tradable_at, p.close, avg(p.close) OVER o AS ma, count(*) OVER o AS n FROM h_signal s JOIN h_price p USING (d) WINDOW o AS (ORDER BY d ROWS 12 PRECEDING)),
    sv AS (SELECT sm.*, CASE WHEN n < 13 THEN 'FLAT' WHEN (close - ma) / greatest(1, abs(ma)) > 0.002 THEN 'UP' WHEN (close - ma) / greatest(1, abs(ma)) < -0.002 THEN 'DOWN' ELSE 'FLAT' END AS dir,
        CASE WHEN v.d IS NULL OR sm.d - v.d > 4 THEN 'UNKNOWN' WHEN v.v >= 28 THEN 'STRESSED' ELSE 'NORMAL' END AS stress FROM sm ASOF LEFT JOIN h_vix v ON sm.d >= v.d),
    sj AS (SELECT arm, sv.*, score, coalesce(last_value(CASE WHEN score > 55 THEN 'BULLISH' WHEN score < 45 THEN 'BEARISH' END IGNORE NULLS) OVER (PARTITION BY arm ORDER BY decision_at ROWS UNBOUNDED PRECEDING), 'NEUTRAL') AS verdict
        FROM sv JOIN sc ON sc.w = CAST(date_trunc('week', sv.d) AS DATE)),
    sb AS (SELECT *, CASE WHEN verdict = 'BULLISH' AND dir = 'DOWN' THEN 0.9 WHEN verdict = 'BULLISH' THEN 1.0 WHEN verdict = 'BEARISH' THEN 0.25 WHEN score < 50 THEN 0.5 ELSE 0.75 END::DOUBLE AS base FROM sj),
    sx AS (SELECT arm, idx, d, decision_at, tradable_at, score, verdict, CASE WHEN stress = 'STRESSED' AND score < 65 THEN 0.25 WHEN stress = 'UNKNOWN' AND base > 0.75 THEN 0.75 ELSE base END AS target_exposure FROM sb),
    e AS (SELECT s.*, p.d AS exec_d, p.close AS price FROM sx s ASOF LEFT JOIN (SELECT d, close, CAST(d AS TIMESTAMP) + INTERVAL 17 HOUR AS b FROM h_price) p ON s.tradable_at < p.b),
    t AS (SELECT *, CASE WHEN exec_d IS NULL THEN 'UNEXECUTED' WHEN row_number() OVER (PARTITION BY arm, exec_d ORDER BY decision_at DESC, idx DESC) = 1 THEN 'EXECUTED' ELSE 'SUPERSEDED' END AS status FROM e),
    x AS (SELECT * FROM t WHERE status = 'EXECUTED')"""


@query("ablation_signals", "h_factor h_signal h_price h_vix", f"WITH {_SIGNALS} SELECT arm, idx, score, verdict, target_exposure, exec_d, status FROM t")
def ablation_signals(spark, sf):
    """Each decision in each arm: its score, verdict, exposure and the session that trades it."""
    return _scheduled(spark, sf).select("arm", "idx", "score", "verdict", "target_exposure", "exec_d", "status")


_BOOKS = """pa AS (SELECT arm, d, close FROM h_price CROSS JOIN arms),
    ev AS (SELECT pa.arm, pa.d, pa.close, coalesce(last_value(x.target_exposure IGNORE NULLS) OVER (PARTITION BY pa.arm ORDER BY pa.d ROWS UNBOUNDED PRECEDING), 0) AS target, lead(pa.d) OVER (PARTITION BY pa.arm ORDER BY pa.d) IS NULL AS is_last
        FROM pa LEFT JOIN x ON x.arm = pa.arm AND x.exec_d = pa.d WHERE pa.d >= (SELECT min(exec_d) FROM x)),
    q AS (SELECT arm || '|strategy' AS methodology, d, close, target FROM ev UNION ALL SELECT arm || '|beta', d, close, avg(target) FILTER (NOT is_last) OVER (PARTITION BY arm) FROM ev),
    s AS (SELECT methodology, d, close, target, lag(d) OVER o AS p, lag(close) OVER o AS pc, lag(target, 1, 0) OVER o AS held FROM q WINDOW o AS (PARTITION BY methodology ORDER BY d)),
    j AS (SELECT s.*, r.rate, v.d AS vd, v.v FROM s ASOF LEFT JOIN h_rate r ON s.p > r.d ASOF LEFT JOIN h_vix v ON s.d >= v.d),
    c AS (SELECT methodology, d, target, abs(target - held) * (3 + CASE WHEN vd IS NULL OR d - vd > 4 OR v >= 28 THEN 3 ELSE 0 END) / 10000 AS cost, CASE WHEN p IS NULL THEN 1 ELSE 1 + held * (close / pc - 1) + (1 - held) * coalesce(rate, 0) / 100 * (d - p) / 360 END AS g FROM j),
    n AS (SELECT methodology, d, target, product(g * (1 - cost)) OVER (PARTITION BY methodology ORDER BY d ROWS UNBOUNDED PRECEDING) AS nav FROM c)"""


@query("ablation_simulation", "h_factor h_signal h_price h_vix h_rate", f"""WITH {_SIGNALS}, {_BOOKS}, {METRICS},
    k AS (SELECT arm, CAST(count(*) AS BIGINT) AS signals, CAST(count(*) FILTER (status = 'EXECUTED') AS BIGINT) AS executed, CAST(count(*) FILTER (status = 'SUPERSEDED') AS BIGINT) AS superseded, CAST(count(*) FILTER (status = 'UNEXECUTED') AS BIGINT) AS unexecuted FROM t GROUP BY 1)
    SELECT k.*, a.sharpe AS strategy_sharpe, b.sharpe AS beta_matched_sharpe, round(a.sharpe - b.sharpe, 5) AS sharpe_delta, a.average_beta, a.max_drawdown,
        CASE WHEN bool_and(executed = signals) OVER () THEN 'OK' ELSE 'DATA_INCOMPLETE' END AS status, CASE WHEN NOT bool_and(executed = signals) OVER () THEN 'EXECUTION_COHORT_INCOMPLETE' END AS reason
    FROM k JOIN me a ON a.methodology = arm || '|strategy' JOIN me b ON b.methodology = arm || '|beta'""")
def ablation_simulation(spark, sf):
    """Each arm's portfolio beside the static one of its own average exposure, and whether all arms were executed whole."""
    done = _scheduled(spark, sf)
    trades = done.where("status = 'EXECUTED'").select("arm", F.col("exec_d").alias("d"), F.col("new_exposure").alias("target"))
    first = F.broadcast(trades.agg(F.min("d").alias("first")))
    ev = N.carry_forward(_prices(spark, sf).join(trades, ["arm", "d"], "left"), "target", ["arm"]).crossJoin(first).where("d >= first").drop("first")
    last = F.lead("d").over(W.partitionBy("arm").orderBy("d")).isNull()
    ev = ev.withColumn("last", last).withColumn("beta", F.avg(F.when(~F.col("last"), F.col("target"))).over(W.partitionBy("arm")))
    books = F.array(F.struct(F.lit("strategy").alias("book"), F.col("target")), F.struct(F.lit("beta").alias("book"), F.col("beta").alias("target")))
    rows = ev.select("arm", "d", "close", F.explode(books).alias("x")).select("arm", "d", "close", "x.*")
    m = M.portfolio_metrics(M.daily_portfolio(rows, h_vix(spark, sf), h_rate(spark, sf), keys=["arm", "book"]), keys=["arm", "book"])
    of = lambda book, c: F.round(F.max(F.when(F.col("book") == book, F.col(c))), 5)
    m = m.groupBy("arm").agg(
        of("strategy", "sharpe").alias("strategy_sharpe"), of("beta", "sharpe").alias("beta_matched_sharpe"), of("strategy", "average_beta").alias("average_beta"), of("strategy", "max_drawdown").alias("max_drawdown"),
    )
    count = lambda s: F.count_if(F.col("status") == s.upper()).alias(s)
    k = done.groupBy("arm").agg(F.count(F.lit(1)).alias("signals"), count("executed"), count("superseded"), count("unexecuted"))
    whole = F.min(F.col("executed") == F.col("signals")).over(W.partitionBy())  # a row for each arm
    return k.join(m, "arm").select(
        "*", F.round(F.col("strategy_sharpe") - F.col("beta_matched_sharpe"), 5).alias("sharpe_delta"),
        F.when(whole, "OK").otherwise("DATA_INCOMPLETE").alias("status"), F.when(~whole, "EXECUTION_COHORT_INCOMPLETE").alias("reason"),
    )


_GREEDY = """od AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY exit_d, exec_d) AS r FROM ok),
    gr AS (SELECT g, r, exit_d, score, fwd FROM od WHERE r = 1 UNION ALL SELECT gr.g, n.r, n.exit_d, n.score, n.fwd FROM gr, LATERAL (SELECT * FROM od WHERE od.g = gr.g AND od.r > gr.r AND od.exec_d >= gr.exit_d ORDER BY od.r LIMIT 1) n)"""


@query("ablation_horizons", "h_factor h_signal h_price h_vix", f"""WITH RECURSIVE {_SIGNALS},
    o AS (SELECT arm || '|' || weeks AS g, x.score, x.exec_d, x.price, x.exec_d + 7 * weeks AS target_d FROM x CROSS JOIN (VALUES (4), (8), (13)) h(weeks)),
    so AS (SELECT o.*, p.d AS exit_d, p.close / price - 1 AS fwd, CASE WHEN p.d - target_d <= 14 THEN 'OK' WHEN TIMESTAMP '{CUTOFF}' <= target_d + 15 THEN 'PENDING' ELSE 'MISSING' END AS status FROM o ASOF LEFT JOIN h_price p ON o.target_d <= p.d),
    ok AS (SELECT * FROM so WHERE status = 'OK'), {_GREEDY}, oi AS ({SPEARMAN.format(k="g", x="score", y="fwd", t="ok", empty="NULL")}), gi AS ({SPEARMAN.format(k="g", x="score", y="fwd", t="gr", empty="NULL")}),
    z AS (SELECT g, round(quantile_cont(fwd, 0.1) FILTER (status = 'OK'), 6) AS q10, CAST(count(*) FILTER (status = 'PENDING') AS BIGINT) AS pending, CAST(count(*) FILTER (status = 'MISSING') AS BIGINT) AS missing FROM so GROUP BY 1)
    SELECT split_part(z.g, '|', 1) AS arm, CAST(split_part(z.g, '|', 2) AS INTEGER) AS weeks, oi.n, oi.ic, gi.n AS independent_n, gi.ic AS independent_ic, q10, pending, missing FROM z JOIN oi USING (g) JOIN gi USING (g)""")
def ablation_horizons(spark, sf):
    """ICs of each arm and horizon over all and over independent outcomes, the tail, and outcomes still open or lost."""
    prices = _prices(spark, sf)
    done = _scheduled(spark, sf).where("status = 'EXECUTED'").select("arm", "exec_d", "score")
    done = done.join(prices.select("arm", F.col("d").alias("exec_d"), F.col("close").alias("price")), ["arm", "exec_d"])
    got = M.outcomes(done, prices, F.lit(CUTOFF).cast("timestamp"), keys=["arm"], weeks=HORIZONS).withColumnRenamed("total_return", "fwd")
    key, ok = ["arm", "weeks"], got.where("status = 'OK'")
    alone = T.earliest_exit_set(ok.select(*key, "exec_d", "exit_d", "score", "fwd"), key, "exec_d", "exit_d")
    z = got.groupBy(*key).agg(
        r6(F.expr("percentile(CASE WHEN status = 'OK' THEN fwd END, 0.1D)"), "q10"), F.count_if(F.col("status") == "PENDING_OUTCOME").alias("pending"),
        F.count_if(F.col("status") == "MISSING_PRICE_COVERAGE").alias("missing"),
    )
    ic = lambda rows, n, c: X.spearman(rows, "score", "fwd", key).select(*key, F.col("n").alias(n), r6("ic", c))
    return z.join(ic(ok, "n", "ic"), key).join(ic(alone, "independent_n", "independent_ic"), key).select(*key, "n", "ic", "independent_n", "independent_ic", "q10", "pending", "missing")
