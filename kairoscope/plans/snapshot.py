"""Queries: snapshots of fourteen series that are derived from the order table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import texts
from ..operators import snapshot as A
from .harness import NEEDS, REL, h_obs, h_price, h_signal, h_week, query

#: Series made from all orders of a day (base + slope * price / 100,000), with the days that they lack.
DAILY = {
    "RRPONTSYD": (500, -100, "false"), "RPONTSYD": (0, 10, "false"), "SOFR": (5, 0.06, "d BETWEEN DATE '1997-03-01' AND DATE '1997-05-10'"),
    "IORB": (5.05, 0, "d BETWEEN DATE '1998-01-05' AND DATE '1998-02-20'"), "VIXCLS": (10, 8, "dayofmonth(d) = 13"),
    "DTWEXBGS": (120, 2, "d BETWEEN DATE '1999-06-01' AND DATE '1999-06-20'"), "SP500": (0, 100000, "false"), "WTREGEN": (700, 50, "false"),
}
#: Weekly ones, on Wednesdays.
WEEKLY = {
    "WALCL": (6000, 150, "d BETWEEN DATE '1996-05-01' AND DATE '1996-05-12'"), "WDTGAL": (700, 50, "d BETWEEN DATE '1996-07-01' AND DATE '1996-08-01'"),
    "WRBWFRBL": (2000, 1000, "d BETWEEN DATE '1997-02-01' AND DATE '1997-03-10'"),
}
#: Those of one priority each, whose days have gaps of their own.
SPARSE = {"BAMLH0A0HYM2": ("1-URGENT", 3, 0.8), "DGS10": ("2-HIGH", 4, 0.3), "T10Y2Y": ("5-LOW", 0, 0.3)}

#: Values are whole steps of 1 / STEPS, the weekly ones of 1 / COARSE.
STEPS, COARSE = 10000.0, 100.0


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _lacks(specs: dict) -> str:
    return " OR ".join(f"(series_id = '{s}' AND {x[2]})" for s, x in specs.items())


REL["h_series"] = f"""
    SELECT series_id, d, floor((base + slope * close / 100000) * {STEPS}) / {STEPS} AS v FROM h_price, (VALUES {_values((s, float(b), float(k)) for s, (b, k, _) in DAILY.items())}) t(series_id, base, slope)
        WHERE NOT ({_lacks(DAILY)})
    UNION ALL SELECT * FROM (SELECT t.series_id, w + 2 AS d, floor((base + slope * v / 100000) * {COARSE}) / {COARSE} AS v FROM h_week h, (VALUES {_values((s, float(b), float(k)) for s, (b, k, _) in WEEKLY.items())}) t(series_id, base, slope)
        WHERE h.series_id = '3-MEDIUM') WHERE NOT ({_lacks(WEEKLY)})
    UNION ALL SELECT t.series_id, d, floor((base + slope * v / 100000) * {STEPS}) / {STEPS} FROM h_obs h JOIN (VALUES {_values((s, p, float(b), float(k)) for s, (p, b, k) in SPARSE.items())}) t(series_id, priority, base, slope) ON h.series_id = priority"""
NEEDS["h_series"] = ["h_price", "h_obs", "h_week"]


def h_series(spark, sf) -> DataFrame:
    def made(rows: DataFrame, specs: dict[str, tuple], value: str, steps: float) -> DataFrame:
        spec = F.explode(F.array(*[F.struct(F.lit(s).alias("series_id"), F.lit(float(b)).alias("b"), F.lit(float(k)).alias("k")) for s, (b, k, _) in specs.items()]))
        rows = rows.withColumn("s", spec).select("s.series_id", "d", (F.floor((F.col("s.b") + F.col("s.k") * F.col(value) / 100000) * steps) / steps).alias("v"))
        return rows.where(f"NOT ({_lacks(specs)})")

    weeks = h_week(spark, sf).where("series_id = '3-MEDIUM'").select(F.date_add("w", 2).alias("d"), "v")
    out = made(h_price(spark, sf), DAILY, "close", STEPS).unionByName(made(weeks, WEEKLY, "v", COARSE))
    obs, name = h_obs(spark, sf), F.col("series_id")
    to = F.coalesce(*[F.when(name == p, s) for s, (p, _, _) in SPARSE.items()])
    b, k = (F.coalesce(*[F.when(name == x[0], float(x[i])) for x in SPARSE.values()]) for i in (1, 2))
    sparse = obs.select(to.alias("series_id"), "d", (F.floor((b + k * F.col("v") / 100000) * STEPS) / STEPS).alias("v")).where("series_id IS NOT NULL")
    return out.unionByName(sparse)


# ---------------------------------------------------------------- the same in SQL


def _clamped(x: str) -> str:
    return f"greatest(0, least(100, {x}))"


def _lin(x: str, a: float, b: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN {_clamped(f'(({x}) - ({a})) / ({b - a:.10g}) * 100')} END"


def _case(column: str, labels: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + " END"


def _weekdays(a: str, b: str) -> str:
    upto = lambda d: f"(({d} - DATE '1969-12-29') // 7 * 5 + least(({d} - DATE '1969-12-29') % 7, 4))"
    return f"({upto(b)} - {upto(a)})"


def _status(found: str, at: str, calendar, business, fallback) -> str:
    stale = f"{at} - {found} > {calendar} OR {_weekdays(found, at)} > {business} OR ({fallback} = 'NONE' AND {found} <> {at})"
    return f"CASE WHEN {found} IS NULL THEN 'MISSING' WHEN {stale} THEN 'STALE' ELSE 'FRESH' END"


def _rule(s: str) -> tuple:
    return P.SERIES[s][2], P.SERIES[s][3], f"'{P.SERIES[s][6]}'"


_IDS = {
    "trend": ["WALCL", "WDTGAL", "RRPONTSYD"], "impulse": ["WALCL"], "credit": ["BAMLH0A0HYM2"], "funding": ["SOFR", "IORB"], "rates": ["DGS10"],
    "dollar": ["DTWEXBGS"], "vol": ["VIXCLS"], "curve": ["T10Y2Y"],
}


def _factor(name: str) -> str:
    """bad, status, score and date of a factor, from columns of ``x``."""
    usable = {"trend": "usable AND len(nets) = 14", "impulse": "usable", "rates": "ch_DGS10 IS NOT NULL", "dollar": "dollar_usable"}.get(name, "true")
    partial = {"credit": "ch_BAMLH0A0HYM2 IS NULL", "curve": "ch_T10Y2Y IS NULL", "reserve": "ch_WRBWFRBL IS NULL OR sofr_iorb IS NULL"}.get(name, "false")
    ids = _IDS.get(name, ["WRBWFRBL"])
    if name == "reserve":  # funding is part of it only where both of its series are fresh
        oldest = "CASE WHEN d_WRBWFRBL IS NOT NULL THEN CASE WHEN sofr_iorb IS NOT NULL THEN least(d_WRBWFRBL, d_SOFR, d_IORB) ELSE d_WRBWFRBL END END"
    else:
        oldest = f"CASE WHEN {' AND '.join(f'd_{s} IS NOT NULL' for s in ids)} THEN {'least(' + ', '.join(f'd_{s}' for s in ids) + ')'} END"
    bad = f"CASE WHEN {' OR '.join(f'st_{s} = $$MISSING$$' for s in ids)} THEN 'MISSING' WHEN {' OR '.join(f'st_{s} = $$STALE$$' for s in ids)} THEN 'STALE' WHEN NOT coalesce({usable}, false) THEN 'MISSING' END"
    share = "(1 - share) * 100"
    change = "ch_BAMLH0A0HYM2"
    level, move, fund = _lin("v_WRBWFRBL", 2800, 3800), _lin("ch_WRBWFRBL", -300, 300), _lin("sofr_iorb", 0.1, 0)
    score = {
        "trend": f"CASE WHEN nets[-1] > netliq_trend THEN 60 ELSE 40 END * 0.5 + {_lin('nets[-1] - nets[-5]', -200, 200)} * 0.5",
        "impulse": "CASE impulse WHEN 'EXPANDING' THEN 80 WHEN 'CONTRACTING' THEN 30 ELSE 55 END",
        "credit": f"CASE WHEN {change} IS NULL THEN {share} ELSE {_clamped(f'{share} * 0.55 + {_lin(change, 1.0, -0.25)} * 0.45 - CASE WHEN share < 0.15 AND {change} > 0.2 THEN 15 ELSE 0 END')} END",
        "funding": fund,
        "rates": _lin("ch_DGS10", 0.5, -0.5),
        "dollar": f"CASE WHEN dollar_sd = 0 THEN 50 ELSE {_lin('(dollar_v - dollar_mean) / dollar_sd', 1, -1)} END",
        "vol": _lin("v_VIXCLS", 30, 12),
        "reserve": f"({level} * 0.5 + coalesce({move} * 0.3, 0) + coalesce({fund} * 0.2, 0)) / (0.5 + CASE WHEN ch_WRBWFRBL IS NULL THEN 0 ELSE 0.3 END + CASE WHEN sofr_iorb IS NULL THEN 0 ELSE 0.2 END)",
        "curve": f"CASE WHEN ch_T10Y2Y IS NULL THEN {_lin('v_T10Y2Y', -0.5, 1.5)} ELSE {_lin('v_T10Y2Y', -0.5, 1.5)} * 0.5 + {_lin('ch_T10Y2Y', -0.3, 0.3)} * 0.5 END",
    }[name]
    return f"""SELECT d, '{name}' AS factor, coalesce({bad}, CASE WHEN {partial} THEN 'PARTIAL' ELSE 'OK' END) AS status,
        CASE WHEN ({bad}) IS NULL THEN {score} END AS score, {oldest} AS as_of FROM x"""


def _fresh_value(name: str, s: str) -> str:
    return f"CASE WHEN ({_status(f'{name}.d', 'w.d', *_rule(s))}) = 'FRESH' THEN {name}.v END"


_LOOKUPS = [(s, 0) for s in P.SERIES] + list(A.LOOKBACK.items())
PARTS = f"""
    rules(series_id, calendar, business, fallback) AS (VALUES {_values((s, *r[2:4], r[6]) for s, r in P.SERIES.items())}),
    probes AS (SELECT d, series_id, back, d - back AS probed FROM dates, (VALUES {_values(_LOOKUPS)}) t(series_id, back)),
    found AS (SELECT p.*, s.d AS sd, s.v FROM probes p ASOF LEFT JOIN h_series s ON p.series_id = s.series_id AND p.probed >= s.d),
    states AS (SELECT f.*, {_status("sd", "probed", "calendar", "business", "fallback")} AS status FROM found f JOIN rules USING (series_id)),
    wide AS (SELECT d, {", ".join(f"max(v) FILTER (series_id = '{s}' AND back = 0 AND status = 'FRESH') AS v_{s}, max(sd) FILTER (series_id = '{s}' AND back = 0) AS d_{s}, max(status) FILTER (series_id = '{s}' AND back = 0) AS st_{s}" for s in P.SERIES)},
        {", ".join(f"max(v) FILTER (series_id = '{s}' AND back > 0 AND status = 'FRESH') AS b_{s}" for s in A.LOOKBACK)} FROM states GROUP BY d),
    weekly AS (SELECT w.d, w.v, w.v - ({_fresh_value("t", "WDTGAL")}) - ({_fresh_value("r", "RRPONTSYD")}) AS net, w.d - lag(w.d) OVER (ORDER BY w.d) AS gap
        FROM (SELECT d, v FROM h_series WHERE series_id = 'WALCL') w ASOF LEFT JOIN (SELECT d, v FROM h_series WHERE series_id = 'WDTGAL') t ON w.d >= t.d
        ASOF LEFT JOIN (SELECT d, v FROM h_series WHERE series_id = 'RRPONTSYD') r ON w.d >= r.d),
    weeks AS (SELECT d, v, lag(v, 13) OVER (ORDER BY d) AS back, coalesce(list(net) FILTER (net IS NOT NULL) OVER (ORDER BY d ROWS 13 PRECEDING), []) AS nets,
        count(*) OVER (ORDER BY d ROWS 13 PRECEDING) = 14 AND min(gap) OVER (ORDER BY d ROWS 12 PRECEDING) >= 5 AND max(gap) OVER (ORDER BY d ROWS 12 PRECEDING) <= 10 AS usable FROM weekly),
    credit AS (SELECT a.d, count(*) FILTER (b.v <= a.v) / count(*) AS share FROM h_series a JOIN h_series b ON a.series_id = b.series_id AND b.d <= a.d WHERE a.series_id = 'BAMLH0A0HYM2' GROUP BY 1),
    dollars AS (SELECT d, v, d - lag(d) OVER (ORDER BY d) AS gap FROM h_series WHERE series_id = 'DTWEXBGS'),
    dollar AS (SELECT d, v, avg(v) OVER y AS mean, stddev_pop(v) OVER y AS sd, count(*) OVER y = 200 AND min(gap) OVER z >= 1 AND max(gap) OVER z <= 4 AS usable
        FROM dollars WINDOW y AS (ORDER BY d ROWS 199 PRECEDING), z AS (ORDER BY d ROWS 198 PRECEDING)),
    x0 AS (SELECT wide.*, {", ".join(f"v_{s} - b_{s} AS ch_{s}" for s in A.LOOKBACK)}, weeks.v AS week_v, weeks.back, weeks.nets, weeks.usable, share,
        dollar.v AS dollar_v, dollar.mean AS dollar_mean, dollar.sd AS dollar_sd, dollar.usable AS dollar_usable, v_SOFR - v_IORB AS sofr_iorb,
        CASE WHEN len(weeks.nets) >= 13 THEN list_sum(weeks.nets[-13:]) / 13 END AS netliq_trend
        FROM wide ASOF JOIN weeks ON wide.d >= weeks.d ASOF LEFT JOIN credit ON wide.d >= credit.d ASOF LEFT JOIN dollar ON wide.d >= dollar.d),
    x AS (SELECT *, CASE WHEN week_v - back > 50 THEN 'EXPANDING' WHEN week_v - back < -50 THEN 'CONTRACTING' ELSE 'FLAT' END AS impulse,
        CASE WHEN (nets[-1] - netliq_trend) / greatest(1, abs(netliq_trend)) > 0.002 THEN 'UP' WHEN (nets[-1] - netliq_trend) / greatest(1, abs(netliq_trend)) < -0.002 THEN 'DOWN' ELSE 'FLAT' END AS direction FROM x0),
    results AS ({" UNION ALL ".join(_factor(n) for n in A.FACTORS)}),
    quality AS (SELECT *, CASE status WHEN 'OK' THEN 1 WHEN 'PARTIAL' THEN 0.5 ELSE 0 END::DOUBLE AS quality FROM results)""".replace("$$MISSING$$", "'MISSING'").replace("$$STALE$$", "'STALE'")


@query("snapshot_factors", "h_signal h_series", f"WITH dates AS (SELECT d FROM h_signal), {PARTS} SELECT d, factor, round(score, 6) AS score, quality, status, as_of FROM quality")
def snapshot_factors(spark, sf):
    """Nine factor results for each weekly date."""
    rows = A.snapshots(h_series(spark, sf), h_signal(spark, sf).select("d")).select("d", F.explode("factors").alias("factor", "r"))
    return rows.select("d", "factor", F.round("r.score", 6).alias("score"), "r.quality", "r.status", "r.as_of")


_WEIGHTS = _values((n, float(w)) for n, w in P.WEIGHTS.items())
_PASS = lambda n: f"coalesce(max(score) FILTER (factor = '{n}') >= 50, false)"
_LABEL = f"""'Fed ' || {_case("impulse", texts.IMPULSE_LABEL)} || '、净流动性' || {_case("direction", texts.DIRECTION_LABEL)} || ' → 环境' || {_case("verdict", texts.VERDICT_LABEL)}
    || CASE WHEN impulse = 'CONTRACTING' AND direction = 'UP' THEN '{texts.EASING_GAP}' WHEN impulse = 'EXPANDING' AND direction = 'DOWN' THEN '{texts.TIGHTENING_GAP}' ELSE '' END"""


#: The decisions ``judged`` of the parts.
JUDGED = f"""weights(factor, weight) AS (VALUES {_WEIGHTS}),
    sums AS (SELECT d, greatest(0, least(100, sum(score * weight) FILTER (weight > 0) / sum(weight) FILTER (weight > 0 AND score IS NOT NULL))) AS all_score, max(status) FILTER (factor = 'trend') = 'OK' AS ok,
        sum(quality) FILTER (factor <> 'vol') / 8 AS coverage, {_PASS("rates")} AND {_PASS("funding")} AND {_PASS("credit")} AS p0, {_PASS("trend")} OR {_PASS("impulse")} AS p1, {_PASS("dollar")} AS p2, {_PASS("vol")} AS p3
        FROM quality JOIN weights USING (factor) GROUP BY d),
    scored AS (SELECT *, CASE WHEN ok THEN all_score END AS score FROM x JOIN sums USING (d)),
    judged AS (SELECT *, CASE WHEN score IS NOT NULL THEN coalesce(last_value(CASE WHEN score > 55 THEN 'BULLISH' WHEN score < 45 THEN 'BEARISH' END IGNORE NULLS) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING), 'NEUTRAL') END AS verdict FROM scored)"""


@query("snapshot_assembly", "h_signal h_series", f"""WITH dates AS (SELECT d FROM h_signal), {PARTS}, {JUDGED}
    SELECT d, v_WALCL AS walcl, v_WDTGAL AS tga, v_RRPONTSYD AS rrp, v_RPONTSYD AS repo, v_BAMLH0A0HYM2 AS hy_oas, v_DGS10 AS dgs10, v_DTWEXBGS AS dxy, v_VIXCLS AS vix,
        round(v_WALCL - v_WDTGAL - v_RRPONTSYD, 6) AS netliq, round(netliq_trend, 6) AS netliq_trend, round(sofr_iorb, 6) AS sofr_iorb, impulse, direction, verdict, round(score, 6) AS score,
        CASE WHEN ok THEN 'OK' ELSE 'DATA_INCOMPLETE' END AS decision_status, coverage, p0, p1, p2, p3, coalesce({_LABEL}, '{texts.INCOMPLETE}') AS reason FROM judged""")
def snapshot_assembly(spark, sf):
    """The decision row of each weekly date, from the series to its reason."""
    rows = A.snapshots(h_series(spark, sf), h_signal(spark, sf).select("d")).drop("factors", "freshness")
    return rows.select(*[F.round(c, 6).alias(c) if c in ("netliq", "netliq_trend", "sofr_iorb", "score") else c for c in rows.columns])
