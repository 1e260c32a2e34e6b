"""Snapshots: from raw series to nine factor results, a score and a decision.

All series of all dates are looked up by one as-of join: a probe for each date,
series and lookback, one exchange on (keys, series) and one sort. What a factor
needs of the past (means, gaps between rows, ranks, weekly net liquidity) is made
beside the series' rows by windows before, so a probe carries it along. The
probes of a date then meet in one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import params as P
from ..functions import scores as C
from ..functions import texts
from ..functions.scalars import clamp
from . import windows as N
from .asof import asof_last, fresh

# Series of the factors, days of their lookbacks, quality and passing score.
WEEKLY, TREASURY, REPO = "WALCL", "WDTGAL", "RRPONTSYD"
LOOKBACK = {"BAMLH0A0HYM2": 20, "DGS10": 20, "T10Y2Y": 20, "WRBWFRBL": 91}
FACTORS = ("trend", "impulse", "credit", "funding", "rates", "dollar", "vol", "reserve", "curve")
COVERED = ("trend", "impulse", "credit", "funding", "rates", "dollar", "reserve", "curve")
REQUIRED = "trend"
DOLLAR_ROWS, SLOPE_WEEKS, PASSING = 200, 4, 50.0
QUALITY = {"OK": 1.0, "PARTIAL": 0.5}

RESULT = "struct<score:double,quality:double,status:string,as_of:date,components:map<string,struct<value:double,date:date,age:bigint,status:string>>,extra:map<string,double>>"


def _gaps_fit(frequency: str, rows: int, order) -> Column:
    """All gaps between the last ``rows`` rows are those of the frequency; null before there are so many."""
    low, high = P.CADENCE[frequency]
    frame = order.rowsBetween(2 - rows, 0)
    fits = (F.min("__gap").over(frame) >= low) & (F.max("__gap").over(frame) <= high)
    return F.when(F.count(F.lit(1)).over(order.rowsBetween(1 - rows, 0)) == rows, fits)


def net_levels(series: DataFrame, keys: list[str]) -> DataFrame:
    """The weekly balance sheet with ``__net``, its level less treasury and repo where both are fresh, and ``__gap``, the days since the row before."""
    of = lambda s: series.where(F.col("series_id") == s)
    weekly = of(WEEKLY).withColumn("__gap", F.datediff("d", F.lag("d").over(W.partitionBy(*keys, "series_id").orderBy("d"))))
    for s, name in ((TREASURY, "__t"), (REPO, "__r")):
        _, _, calendar, business, _, _, fallback = P.SERIES[s]
        weekly = asof_last(weekly, of(s).select(*keys, "d", "v"), keys=keys, carry=["v"], prefix=f"{name}_")
        at = fresh(F.col(f"{name}_v"), F.col(f"{name}_date"), F.col("d"), calendar_days=calendar, business_days=business, fallback=F.lit(fallback))
        weekly = weekly.withColumn(name, at["value"])
    return weekly.withColumn("__net", C.net_liquidity("v", "__t", "__r"))


def history(series: DataFrame, keys: list[str]) -> DataFrame:
    """``series`` (keys, series_id, d, v) with what its factors need of the past up to each row."""
    key = [*keys, "series_id"]
    order = W.partitionBy(*key).orderBy("d")
    of = lambda s: series.where(F.col("series_id") == s)
    gapped = lambda s: of(s).withColumn("__gap", F.datediff("d", F.lag("d").over(order)))

    special = [WEEKLY, "BAMLH0A0HYM2", "DTWEXBGS"]
    plain = series.where(~F.col("series_id").isin(special)).select(*key, "d", "v")

    weekly = net_levels(series, keys)
    rows = P.TREND_WEEKS + 1
    weekly = weekly.select(
        *key, "d", "v", F.lag("v", P.TREND_WEEKS).over(order).alias("back"), F.collect_list("__net").over(order.rowsBetween(1 - rows, 0)).alias("nets"),
        F.coalesce(_gaps_fit("WEEKLY", rows, order), F.lit(False)).alias("usable"),
        F.count(F.lit(1)).over(order.rowsBetween(1 - rows, 0)).alias("n"),
    )
    credit = N.expanding_share(of("BAMLH0A0HYM2"), "v", key).select(*key, "d", "v", "share")
    frame = order.rowsBetween(1 - DOLLAR_ROWS, 0)
    dollar = gapped("DTWEXBGS").select(
        *key, "d", "v", F.avg("v").over(frame).alias("mean"), F.stddev_pop("v").over(frame).alias("sd"), F.row_number().over(order).cast("long").alias("n"),
        F.coalesce(_gaps_fit("DAILY", DOLLAR_ROWS, order), F.lit(False)).alias("usable"),
    )
    out = plain
    for part in (weekly, credit, dollar):
        out = out.unionByName(part, allowMissingColumns=True)
    return out


CARRIED = ["v", "back", "nets", "usable", "n", "share", "mean", "sd"]


def _value(s: str) -> Column:
    return F.col(f"now.{s}.fresh.value")


def _change(s: str) -> Column:
    """Change over the lookback; null unless both ends are fresh."""
    return _value(s) - F.col(f"then.{s}.fresh.value")


def _looked_up(series: DataFrame, dates: DataFrame, keys: list[str]) -> DataFrame:
    """``dates`` with now and then: for each series its freshness and what its row carries."""
    rules = [(s, "now", 0, c, b, f) for s, (_, _, c, b, _, _, f) in P.SERIES.items()]
    rules += [(s, "then", days, *(P.SERIES[s][i] for i in (2, 3, 6))) for s, days in LOOKBACK.items()]
    wanted = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("series_id", "part", "back", "calendar", "business", "fallback"))]) for r in rules])
    probes = dates.withColumn("__p", F.explode(wanted)).select(*dates.columns, "__p.*").withColumn("__at", F.date_sub("d", F.col("back")))
    got = asof_last(probes.drop("back"), history(series, keys), keys=[*keys, "series_id"], on="__at", data_on="d", carry=CARRIED, prefix="g_")
    state = fresh(F.col("g_v"), F.col("g_date"), F.col("__at"), calendar_days=F.col("calendar"), business_days=F.col("business"), fallback=F.col("fallback"))
    got = got.withColumn("__s", F.struct(state.alias("fresh"), *[F.col(f"g_{c}").alias(c) for c in CARRIED]))
    pick = lambda s, part: F.max_by("__s", F.when((F.col("series_id") == s) & (F.col("part") == part), 1)).alias(s)
    picked = [pick(s, "now").alias(f"now_{s}") for s in P.SERIES] + [pick(s, "then").alias(f"then_{s}") for s in LOOKBACK]
    one = got.groupBy(*dates.columns).agg(*picked)
    now = F.struct(*[F.col(f"now_{s}").alias(s) for s in P.SERIES])
    return one.select(*dates.columns, now.alias("now"), F.struct(*[F.col(f"then_{s}").alias(s) for s in LOOKBACK]).alias("then"))


def _result(ids: list[str], score: Column, *, usable: Column | None = None, partial: Column | None = None, extra: dict[str, Column] | None = None) -> Column:
    """A factor's result: missing beats stale beats unusable history; the oldest date, none if one is missing."""
    states = [F.col(f"now.{s}.fresh.status") for s in ids]
    some = lambda what: F.greatest(*[(x == what) for x in states], F.lit(False))
    bad = F.when(some("MISSING"), "MISSING").when(some("STALE"), "STALE")
    if usable is not None:
        bad = bad.when(~F.coalesce(usable, F.lit(False)), "MISSING")
    part = F.lit(False) if partial is None else partial
    found = [F.col(f"now.{s}.fresh.date") for s in ids]
    none = F.greatest(*[d.isNull() for d in found], F.lit(False))
    oldest = F.when(~none, found[0] if len(found) == 1 else F.least(*found))
    status = F.coalesce(bad, F.when(part, "PARTIAL").otherwise("OK"))
    quality = F.when(status == "OK", QUALITY["OK"]).when(status == "PARTIAL", QUALITY["PARTIAL"]).otherwise(0.0)
    parts = F.create_map(*[x for s in ids for x in (F.lit(s), F.col(f"now.{s}.fresh"))])
    more = F.create_map(*[x for n, c in (extra or {}).items() for x in (F.lit(n), c.cast("double"))]) if extra else F.lit(None)
    held = F.struct(F.when(bad.isNull(), score).alias("score"), quality.alias("quality"), status.alias("status"), oldest.alias("as_of"), parts.alias("components"), more.alias("extra"))
    return held.cast(RESULT)


def _mean_of_last(a: Column, n: int) -> Column:
    return F.when(F.size(a) >= n, F.aggregate(F.slice(a, -n, n), F.lit(0.0), lambda s, x: s + x) / n)


def snapshots(series: DataFrame, dates: DataFrame, *, keys: list[str] = (), previous: str | None = None) -> DataFrame:
    """A snapshot for each row of ``dates`` (keys, d and, if named, the previous verdict).

    ``series`` has keys, series_id, d and v, a row for each date. Without ``previous``
    the verdict of the earlier snapshots of the keys is carried. Dates before the first
    row of the weekly balance sheet have no snapshot. Null dates have none either.
    """
    keys = list(keys)
    rows = _looked_up(series, dates.where(F.col("d").isNotNull()), keys).where(F.col(f"now.{WEEKLY}.fresh.date").isNotNull())
    nets, n_nets = F.col(f"now.{WEEKLY}.nets"), F.size(f"now.{WEEKLY}.nets")
    weeks = P.TREND_WEEKS + 1
    rows = rows.withColumn("netliq_trend", _mean_of_last(nets, P.TREND_WEEKS)).withColumn("__last", F.when(n_nets > 0, F.element_at(nets, -1)))
    full = F.col(f"now.{WEEKLY}.n") == weeks
    rows = rows.withColumn("impulse", C.impulse_label(F.when(full, F.col(f"now.{WEEKLY}.v")), F.when(full, F.col(f"now.{WEEKLY}.back"))))
    rows = rows.withColumn("direction", C.direction("__last", "netliq_trend")).withColumn("sofr_iorb", _value("SOFR") - _value("IORB"))
    usable = F.col(f"now.{WEEKLY}.usable")
    slope_from = F.when(n_nets > SLOPE_WEEKS, F.element_at(nets, -1 - SLOPE_WEEKS))
    funded = F.col("sofr_iorb").isNotNull()
    share, level = F.col("now.BAMLH0A0HYM2.share"), _value("WRBWFRBL")
    funding = C.funding_score("sofr_iorb")
    dollar = C.dollar_score(F.col("now.DTWEXBGS.v"), F.col("now.DTWEXBGS.mean"), F.col("now.DTWEXBGS.sd"), F.col("now.DTWEXBGS.n"))
    reserve = clamp(C.available_reserve_score(level, _change("WRBWFRBL"), funding))
    reserve_of = {"change": _change("WRBWFRBL"), "sofr": _value("SOFR"), "iorb": _value("IORB")}
    lookback = lambda s: {"lookback_change": _change(s)}
    reserve_part = _change("WRBWFRBL").isNull() | ~funded
    results = {
        "trend": _result(
            [WEEKLY, TREASURY, REPO], C.trend_score("__last", "netliq_trend", slope_from, F.lit(0.0)), usable=usable & (n_nets == weeks),
            extra={"history_observations": n_nets, "cadence_observations": F.col(f"now.{WEEKLY}.n")},
        ),
        "impulse": _result([WEEKLY], C.impulse_score("impulse"), usable=usable, extra={"history_observations": F.col(f"now.{WEEKLY}.n")}),
        "credit": _result(["BAMLH0A0HYM2"], C.available_credit_score(share, _change("BAMLH0A0HYM2")), partial=_change("BAMLH0A0HYM2").isNull(), extra=lookback("BAMLH0A0HYM2")),
        "funding": _result(["SOFR", "IORB"], funding),
        "rates": _result(["DGS10"], C.rates_score(_change("DGS10")), usable=_change("DGS10").isNotNull(), extra=lookback("DGS10")),
        "dollar": _result(["DTWEXBGS"], dollar, usable=F.col("now.DTWEXBGS.usable"), extra={"history_observations": F.col("now.DTWEXBGS.n")}),
        "vol": _result(["VIXCLS"], C.vol_score(_value("VIXCLS"))),
        "reserve": F.when(funded, _result(["WRBWFRBL", "SOFR", "IORB"], reserve, partial=reserve_part, extra=reserve_of)).otherwise(
            _result(["WRBWFRBL"], reserve, partial=reserve_part, extra=reserve_of)
        ),
        "curve": _result(["T10Y2Y"], C.available_curve_score(_value("T10Y2Y"), _change("T10Y2Y")), partial=_change("T10Y2Y").isNull(), extra=lookback("T10Y2Y")),
    }
    for name in FACTORS:
        rows = rows.withColumn(f"f_{name}", results[name])
    of = lambda n: F.col(f"f_{n}.score")
    ok = F.col(f"f_{REQUIRED}.status") == "OK"
    score = clamp(C.available_score([(w, of(n)) for n, w in P.WEIGHTS.items() if w > 0]))
    passes = lambda n: F.coalesce(of(n) >= PASSING, F.lit(False))
    coverage = sum((F.col(f"f_{n}.quality") for n in COVERED), F.lit(0.0)) / len(COVERED)
    rows = rows.withColumn("score", F.when(ok, score)).withColumn("decision_status", F.when(ok, "OK").otherwise("DATA_INCOMPLETE")).withColumn("coverage", coverage)
    carried = F.coalesce(C.band("score"), F.col(previous), F.lit("NEUTRAL")) if previous else N.hysteresis(C.band("score"), keys, "d")
    rows = rows.withColumn("verdict", F.when(F.col("score").isNotNull(), carried))
    levels = {"walcl": "WALCL", "tga": "WDTGAL", "rrp": "RRPONTSYD", "repo": "RPONTSYD", "hy_oas": "BAMLH0A0HYM2", "dgs10": "DGS10", "dxy": "DTWEXBGS", "vix": "VIXCLS"}
    return rows.select(
        *keys, "d", *[_value(s).alias(n) for n, s in levels.items()], C.net_liquidity(_value(WEEKLY), _value(TREASURY), _value(REPO)).alias("netliq"),
        "netliq_trend", "sofr_iorb", "impulse", "direction", "verdict", "score", "decision_status", "coverage",
        (passes("rates") & passes("funding") & passes("credit")).alias("p0"), (passes("trend") | passes("impulse")).alias("p1"), passes("dollar").alias("p2"), passes("vol").alias("p3"),
        F.coalesce(texts.reason("impulse", "direction", "verdict"), F.lit(texts.INCOMPLETE)).alias("reason"),
        F.create_map(*[x for n in FACTORS for x in (F.lit(n), F.col(f"f_{n}"))]).alias("factors"),
        F.create_map(*[x for s in P.SERIES for x in (F.lit(s), F.col(f"now.{s}.fresh"))]).alias("freshness"),
    )
