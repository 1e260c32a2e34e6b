"""Scheduling, daily portfolios, outcomes, folds and bootstraps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import params as P
from ..functions.scalars import at_time
from .asof import asof_first, asof_last
from .windows import drawdown


def schedule(signals: DataFrame, prices: DataFrame, *, keys: list[str]) -> DataFrame:
    """Adds exec_d, status (EXECUTED, SUPERSEDED, UNEXECUTED), old_exposure and new_exposure.

    A session can be traded if its 17:00 UTC bound is after ``tradable_at``; of
    the signals of one session the latest decision wins, then the later index.
    """
    bounds = prices.select(*keys, at_time("d", P.ELIGIBLE_AT).alias("bound"), F.col("d").alias("session"))
    got = asof_first(signals, bounds, keys=keys, on="tradable_at", data_on="bound", carry=["session"], prefix="x_", strict=True)
    got = got.withColumnRenamed("x_session", "exec_d").drop("x_date")
    w = W.partitionBy(*keys, "exec_d").orderBy(F.col("decision_at").desc(), F.col("idx").desc())
    first = F.row_number().over(w) == 1
    got = got.withColumn("status", F.when(F.col("exec_d").isNull(), "UNEXECUTED").when(first, "EXECUTED").otherwise("SUPERSEDED"))
    target = F.coalesce("target_exposure", F.when(F.col("score") > 55, 1.0).otherwise(0.0))
    done = got.withColumn("new_exposure", F.when(F.col("status") == "EXECUTED", target))
    chain = W.partitionBy(*keys, "status").orderBy("exec_d", "idx")
    old = F.when(F.col("status") == "EXECUTED", F.lag("new_exposure", 1, 0.0).over(chain))
    return done.withColumn("old_exposure", old)


def _on_days(rows: DataFrame, data: DataFrame, on: str, carry: str, prefix: str, strict: bool = False) -> DataFrame:
    """As-of values for the days of ``rows``: looked up once for each day of the calendar, then joined by day,
    so that the sessions of all keys never meet in one task."""
    days = asof_last(rows.select(on).where(F.col(on).isNotNull()).distinct(), data, keys=[], on=on, data_on="d", carry=[carry], prefix=prefix, strict=strict)
    return rows.join(days, on, "left")


def daily_portfolio(sessions: DataFrame, vix: DataFrame, rates: DataFrame, *, keys: list[str]) -> DataFrame:
    """``sessions``: keys, d, close, target. Adds returns, costs, nav and complete.

    The exposure path is given, so every session's factor is local to its row
    and the next one, and the value is a running product.
    """
    w = W.partitionBy(*keys).orderBy("d")
    s = sessions.select(*sessions.columns, F.lag("d").over(w).alias("prev_d"), F.lag("close").over(w).alias("prev_close"), F.lag("target", 1, 0.0).over(w).alias("held"))
    s = _on_days(_on_days(s, rates, "prev_d", "rate", "r_", strict=True), vix, "d", "v", "x_")
    first = F.col("prev_d").isNull()
    days = F.datediff("d", "prev_d")
    annual = F.col("r_rate") / 100.0
    funding = F.when(F.col("held") <= 1, annual).otherwise(annual + P.FINANCING_BPS / 1e4)
    asset = F.when(first, 0.0).otherwise(F.col("held") * (F.col("close") / F.col("prev_close") - 1.0))
    cash = F.when(first, 0.0).otherwise((1.0 - F.col("held")) * funding * days / 360.0)
    turnover = F.abs(F.col("target") - F.col("held"))
    stressed = F.col("x_date").isNull() | (F.datediff("d", "x_date") > P.VIX_STALE_DAYS) | (F.col("x_v") >= P.VIX_STRESS)
    bps = F.lit(P.COMMISSION_BPS + P.SLIPPAGE_BPS) + F.when(stressed, P.STRESS_SLIPPAGE_BPS).otherwise(0.0)
    fixed = first | (F.col("r_date").isNotNull() & (F.datediff("prev_d", "r_date") <= P.CASH_STALE_DAYS))
    s = s.select(
        *sessions.columns, "held", asset.alias("asset_return"), cash.alias("cash_return"), turnover.alias("turnover"),
        F.when(turnover > 0, turnover * bps / 1e4).otherwise(0.0).alias("trade_cost"), fixed.alias("fixed"),
    )
    growth = (1.0 + F.col("asset_return") + F.col("cash_return")) * (1.0 - F.col("trade_cost"))
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    complete = F.min(F.col("fixed")).over(W.partitionBy(*keys))
    return s.select("*", F.product(growth).over(upto).alias("nav"), complete.alias("complete")).drop("fixed")


def portfolio_metrics(nav: DataFrame, *, keys: list[str]) -> DataFrame:
    """Total return, average beta, annualised deviation, Sharpe, Sortino, drawdown and its length."""
    w = W.partitionBy(*keys).orderBy("d")
    rows = drawdown(nav, keys, start=1.0)
    rows = rows.withColumn("ret", F.col("nav") / F.lag("nav", 1, 1.0).over(w) - 1.0).withColumn("__last", F.lead("d").over(w).isNull())
    sd, n = F.stddev_pop("ret"), F.count(F.lit(1))
    year = F.sqrt(F.lit(float(P.SESSIONS)))
    down = F.sqrt(F.sum(F.pow(F.least("ret", F.lit(0.0)), 2)) / n)
    enough = lambda c: F.when(n >= 2, c)
    return rows.groupBy(*keys).agg(
        enough(F.max_by("nav", "d") - 1.0).alias("total_return"),
        enough(F.avg(F.when(~F.col("__last"), F.col("target")))).alias("average_beta"),
        enough(sd * year).alias("volatility"),
        enough(F.when(sd > 0, F.avg("ret") / F.when(sd > 0, sd) * year)).alias("sharpe"),
        enough(F.when(down > 0, F.avg("ret") / F.when(down > 0, down) * year)).alias("sortino"),
        enough(F.min(F.least("drawdown", F.lit(0.0)))).alias("max_drawdown"),
        enough(F.max("below")).alias("drawdown_sessions"),
    )


def outcomes(executions: DataFrame, prices: DataFrame, cutoff: Column, *, keys: list[str], weeks=(4, 8, 13)) -> DataFrame:
    """Execution x horizon: target_d, exit_d, status, total_return, worst_drawdown."""
    rows = executions.withColumn("weeks", F.explode(F.array(*[F.lit(w) for w in weeks])))
    rows = rows.withColumn("target_d", F.date_add("exec_d", F.col("weeks") * 7))
    got = asof_first(rows, prices, keys=keys, on="target_d", data_on="d", carry=["close"], prefix="x_")
    ok = F.datediff("x_date", "target_d") <= P.TOLERANCE_DAYS
    due = F.date_add("target_d", P.TOLERANCE_DAYS + 1).cast("timestamp")
    status = (
        F.when(F.col("exec_d").isNull(), "UNEXECUTED").when(ok, "OK").when(cutoff <= due, "PENDING_OUTCOME").otherwise("MISSING_PRICE_COVERAGE")
    )
    got = got.withColumn("status", status).withColumn("exit_d", F.when(ok, F.col("x_date")))
    got = got.withColumn("total_return", F.when(ok, F.col("x_close") / F.col("price") - 1.0)).drop("x_date", "x_close")
    # executions meet the prices of their own weeks only
    week = lambda c: F.date_trunc("week", c).cast("date")
    held = got.where("status = 'OK'").select(*keys, "exec_d", "weeks", "exit_d").distinct()
    held = held.withColumn("__w", F.explode(F.sequence(week("exec_d"), week("exit_d"), F.expr("interval 7 days"))))
    path = held.join(prices.withColumn("__w", week("d")), [*keys, "__w"]).where(F.col("d").between(F.col("exec_d"), F.col("exit_d")))
    worst = drawdown(path, [*keys, "exec_d", "weeks"], value="close").groupBy(*keys, "exec_d", "weeks").agg(F.min("drawdown").alias("worst_drawdown"))
    return got.join(worst, [*keys, "exec_d", "weeks"], "left")


# ---------------------------------------------------------------- bootstraps


MASK = 0xFFFFFFFF
#: Steps of the congruential generator that a draw's number may have, as a power of two.
LCG_BITS = 40


def _imul(x: Column, y: Column) -> Column:
    """Product modulo 2**32 of two numbers under 2**32, in halves, as a long would overflow."""
    low, high = x.bitwiseAND(F.lit(0xFFFF)), F.shiftright(x, 16)
    return (F.shiftleft((high * y).bitwiseAND(F.lit(0xFFFF).cast("long")), 16) + low * y).bitwiseAND(F.lit(MASK))


def mulberry32(seed: int, k: Column) -> Column:
    """Draw number ``k`` (from 0) of the 32-bit generator. Its state is a counter, so each draw stands alone."""
    a = (F.lit(seed).cast("long") + (k.cast("long") + 1) * F.lit(0x6D2B79F5).cast("long")).bitwiseAND(F.lit(MASK))
    steps = [
        lambda a: _imul(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1).cast("long"))),
        lambda t: (t + _imul(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(F.lit(MASK)).bitwiseXOR(t),
        lambda t: t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(4294967296.0),
    ]
    held = F.array(a)
    for step in steps:  # a lambda's variable holds each value once
        held = F.transform(held, step)
    return F.element_at(held, 1)


def lcg(seed: int, k: Column) -> Column:
    """Draw number ``k`` (from 0) of x -> 1664525 x + 1013904223 modulo 2**32.

    The step applied 2**m times is again such a step, so a draw is reached by the bits of its number.
    """
    a, c, jumps = 1664525, 1013904223, []
    for m in range(LCG_BITS):
        jumps.append(F.struct(F.lit(m).alias("m"), F.lit(a).cast("long").alias("a"), F.lit(c).cast("long").alias("c")))
        a, c = a * a & MASK, (a * c + c) & MASK
    n = k.cast("long") + 1
    bit = lambda j: F.call_function("getbit", n, j["m"]) == 1
    x = F.aggregate(F.array(*jumps), F.lit(seed).cast("long"), lambda x, j: F.when(bit(j), (_imul(x, j["a"]) + j["c"]).bitwiseAND(F.lit(MASK))).otherwise(x))
    return x / F.lit(4294967296.0)


def block_bootstrap(rows: DataFrame, *, n: int, block: int, iterations: int, draw, first: int = 0) -> DataFrame:
    """``rows`` (idx from 0) in resamples ``iter``: circular blocks from drawn starts, cut at ``n`` rows.

    ``draw`` gives the uniform draw of a number; ``first`` is the number of the first one. All of it is made in tasks.
    """
    per = -(-n // block)
    k = rows.sparkSession.range(iterations * per)
    starts = k.select(F.floor(F.col("id") / per).alias("iter"), F.pmod("id", F.lit(per)).alias("b"), F.floor(draw(F.col("id") + first) * n).alias("start"))
    spread = starts.select("iter", (F.col("b") * block).alias("base"), "start", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("o"))
    picked = spread.where(F.col("base") + F.col("o") < n).select("iter", F.pmod(F.col("start") + F.col("o"), F.lit(n)).alias("idx"))
    return picked.join(rows, "idx")


def keyed_block_bootstrap(rows: DataFrame, keys: list[str], *, block: int, iterations: int, draw) -> DataFrame:
    """``block_bootstrap`` of each key's rows (idx from 0 in the key); each key begins with the first draw."""
    sizes = F.broadcast(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")))  # a row for each key
    starts = rows.sparkSession.range(iterations).withColumnRenamed("id", "iter").crossJoin(sizes).withColumn("__per", F.ceil(F.col("__n") / block))
    starts = starts.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__per") - 1)))
    starts = starts.withColumn("__start", F.floor(draw(F.col("iter") * F.col("__per") + F.col("__b")) * F.col("__n")))
    spread = starts.withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).where(F.col("__b") * block + F.col("__o") < F.col("__n"))
    return spread.select(*keys, "iter", F.pmod(F.col("__start") + F.col("__o"), F.col("__n")).alias("idx")).join(rows, [*keys, "idx"])
