"""Queries: the second horizon beside snapshots that are assembled from the same series."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..operators import dual_horizon as D
from ..operators.snapshot import COVERED, snapshots
from .harness import h_signal, query
from .inputs import GATE
from .snapshot import JUDGED, PARTS, _lin, _rule, _status, h_series
from .temporal import MAD

#: More weekly snapshots than this are refused, so that the last ones of the tables are.
MOST = 335


def _fridays(spark, sf):
    """Decisions on Fridays and one before all data; on the 13th the two inputs were read at different instants."""
    week = h_signal(spark, sf).select(F.date_add(F.date_trunc("week", "d").cast("date"), 4).alias("d")).distinct()
    return week, week.unionByName(week.sparkSession.createDataFrame([("1994-12-02",)], "d string").select(F.col("d").cast("date")))


def _latent(level: str) -> str:
    """CTEs from the points ``pt`` to ``l_<level>`` (d, latent)."""
    return f"""
    i_{level} AS (SELECT d, {level} - lag({level}, 4) OVER x AS i4, {level} - lag({level}, 13) OVER x AS i13, CASE WHEN count(*) OVER y = 13 THEN {level} - avg({level}) OVER y END AS gap FROM pt WINDOW x AS (ORDER BY d), y AS (ORDER BY d ROWS 12 PRECEDING)),
    p_{level} AS (SELECT *, list(gap) FILTER (gap IS NOT NULL) OVER z AS gp, list(i4) FILTER (i4 IS NOT NULL) OVER z AS p4, list(i13) FILTER (i13 IS NOT NULL) OVER z AS p13 FROM i_{level} WINDOW z AS (ORDER BY d ROWS BETWEEN 156 PRECEDING AND 1 PRECEDING)),
    l_{level} AS (SELECT d, 0.45 * gap / ({MAD.format("gp")}) + 0.35 * i4 / ({MAD.format("p4")}) + 0.2 * i13 / ({MAD.format("p13")}) AS latent FROM p_{level})"""


_SIGN = lambda x: f"CASE WHEN {x} > 0 THEN 'UP' WHEN {x} < 0 THEN 'DOWN' ELSE 'FLAT' END"
_SIDES = ["t_trend", "f_dollar", "f_reserve", "f_curve"]
_STATUS_SCORE = "CASE status WHEN 'OK' THEN 100 WHEN 'PARTIAL' THEN 50 ELSE 0 END"


@query("dual_horizon", "h_signal h_series", f"""
    WITH dates AS (SELECT DISTINCT CAST(date_trunc('week', d) AS DATE) + 4 AS d FROM h_signal), {PARTS}, {JUDGED},
    dec AS (SELECT 'x' AS book, d FROM dates UNION ALL SELECT 'x', DATE '1994-12-02'), bk AS (SELECT 'x' AS book, * FROM h_series), {GATE},
    fm AS (SELECT d, score, verdict, direction, impulse, v_VIXCLS AS vix, row_number() OVER (ORDER BY d) AS place, count(*) OVER (PARTITION BY impulse ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same FROM judged),
    fs AS (SELECT d, {", ".join(f"max(score) FILTER (factor = '{n}') AS f_{n}" for n in COVERED)}, avg({_STATUS_SCORE}) FILTER (factor <> 'vol') AS freshness FROM quality GROUP BY d),
    wa AS (SELECT a.d, a.v, t.v AS t, r.v AS r, r.m, r.n, (SELECT avg(v) FROM h_series w WHERE w.series_id = 'WTREGEN' AND w.d BETWEEN a.d - 6 AND a.d) AS week
        FROM (SELECT d, v FROM h_series WHERE series_id = 'WALCL') a JOIN (SELECT d, v FROM h_series WHERE series_id = 'WDTGAL') t ON t.d = a.d
        ASOF LEFT JOIN (SELECT d, v, avg(v) OVER (ORDER BY d ROWS 4 PRECEDING) AS m, count(*) OVER (ORDER BY d ROWS 4 PRECEDING) AS n FROM h_series WHERE series_id = 'RRPONTSYD') r ON a.d >= r.d),
    pt AS (SELECT d, v - t - r AS raw, v - week - m AS smooth FROM wa WHERE n = 5 AND week IS NOT NULL), {_latent("raw")}, {_latent("smooth")},
    lt AS (SELECT a.d, a.latent AS raw_latent, b.latent AS smooth_latent FROM l_raw a JOIN l_smooth b ON a.d = b.d),
    tt AS (SELECT d, CASE WHEN count(net) OVER five = 5 AND min(gap) OVER four >= 5 AND max(gap) OVER four <= 10 THEN CASE WHEN net > avg(net) OVER four THEN 60 ELSE 40 END * 0.5 + {_lin("net - first_value(net) OVER five", -200, 200)} * 0.5 END AS trend
        FROM weekly WINDOW five AS (ORDER BY d ROWS 4 PRECEDING), four AS (ORDER BY d ROWS 3 PRECEDING)),
    j AS (SELECT dec.d, day(dec.d) = 13 AS shifted, fm.d AS snap, fm.score, verdict, direction, vix, place, same, {", ".join(f"f_{n}" for n in COVERED)}, freshness, gt.reason AS gate, n_anchors, raw_latent, smooth_latent, tt.d AS td, tt.trend AS t_trend
        FROM dec JOIN gt ON gt.d = dec.d ASOF LEFT JOIN fm ON dec.d >= fm.d LEFT JOIN fs ON fs.d = fm.d ASOF LEFT JOIN lt ON dec.d - 7 >= lt.d ASOF LEFT JOIN tt ON dec.d >= tt.d),
    k AS (SELECT *, CASE WHEN shifted THEN 'AS_OF_CUTOFF_MISMATCH' WHEN snap IS NULL THEN 'NO_GOVERNED_FORMAL_SNAPSHOT' WHEN place > {MOST} THEN 'SNAPSHOT_WORK_LIMIT_EXCEEDED' WHEN verdict IS NULL THEN 'FORMAL_SNAPSHOT_INVALID'
            WHEN {" OR ".join(f"f_{n} IS NULL" for n in COVERED)} THEN 'MISSING_FORMAL_FACTOR_COHORT' WHEN gate IS NOT NULL OR raw_latent IS NULL OR smooth_latent IS NULL THEN 'MISSING_RAW_SMOOTH_HISTORY'
            WHEN t_trend IS NULL OR ({_status("td", "d", *_rule("WALCL"))}) <> 'FRESH' THEN 'MISSING_TACTICAL_HISTORY' END AS issue,
        greatest(0, least(100, t_trend * {P.WEIGHTS["trend"]} + {" + ".join(f"f_{n} * {P.WEIGHTS[n]}" for n in COVERED if n != "trend")})) AS t,
        {" + ".join(f"CASE WHEN {s} > 55 THEN 1 ELSE 0 END" for s in _SIDES)} AS up, {" + ".join(f"CASE WHEN {s} < 45 THEN 1 ELSE 0 END" for s in _SIDES)} AS down,
        CASE WHEN raw_latent = 0 OR smooth_latent = 0 THEN 'TRANSITION' WHEN {_SIGN("raw_latent")} = {_SIGN("smooth_latent")} THEN 'HIGH' ELSE 'LOW' END AS agreement,
        CASE WHEN vix IS NULL THEN 'UNKNOWN' WHEN vix >= 28 THEN 'STRESSED' ELSE 'NORMAL' END AS stress,
        CASE WHEN verdict = 'BULLISH' AND direction = 'DOWN' THEN 0.9 WHEN verdict = 'BULLISH' THEN 1.0 WHEN verdict = 'BEARISH' THEN 0.25 WHEN score < 50 THEN 0.5 ELSE 0.75 END::DOUBLE AS plain FROM j),
    m AS (SELECT *, (100 + freshness + least(100, same / 52 * 100) + greatest(up + (4 - up - down) * 0.5, down + (4 - up - down) * 0.5) * 25 + CASE agreement WHEN 'HIGH' THEN 100 WHEN 'LOW' THEN 0 ELSE 50 END) / 5 AS c,
        CASE WHEN stress = 'STRESSED' AND score < 65 THEN 0.25 WHEN stress = 'UNKNOWN' AND plain > 0.75 THEN 0.75 ELSE plain END AS base FROM k),
    n AS (SELECT *, greatest(0.25, least(1, base + CASE WHEN t >= 60 AND c >= 60 THEN 0.1 WHEN t <= 40 THEN -0.1 ELSE 0 END)) AS moved FROM m)
    SELECT d, CASE WHEN issue IS NULL THEN 'OK' ELSE 'DATA_INCOMPLETE' END AS status,
        coalesce(issue, CASE WHEN t >= 60 THEN 'TACTICAL_UP' WHEN t <= 40 THEN 'TACTICAL_DOWN' ELSE 'TACTICAL_NEUTRAL' END || CASE WHEN t >= 60 AND c < 60 THEN ',UPWARD_ADJUSTMENT_BLOCKED_LOW_CONFIDENCE' ELSE '' END
            || CASE WHEN c < 40 THEN ',LOW_CONFIDENCE_EXPOSURE_CAP' ELSE '' END || ',RAW_SMOOTH_' || agreement) AS reasons,
        CASE WHEN issue IS NULL THEN round(score, 6) END AS strategic_score, CASE WHEN issue IS NULL THEN round(t, 6) END AS tactical_score, CASE WHEN issue IS NULL THEN round(c, 6) END AS confidence, CASE WHEN issue IS NULL THEN base END AS base_exposure,
        CASE WHEN issue IS NULL THEN round(CASE WHEN c < 40 THEN least(moved, 0.75) ELSE moved END, 6) END AS shadow_exposure, CASE WHEN issue IS NULL THEN round(raw_latent, 6) END AS raw_latent, CASE WHEN issue IS NULL THEN round(smooth_latent, 6) END AS smooth_latent,
        CASE WHEN issue IS NULL THEN n_anchors END AS sample_count FROM n""")
def dual_horizon(spark, sf):
    """Each Friday's second horizon: its reasons, tactical score, measured confidence and exposure."""
    dates, decisions = _fridays(spark, sf)
    series = h_series(spark, sf)
    read = lambda days: F.date_add("d", days).cast("timestamp")
    decisions = decisions.select("d", read(1).alias("snapshot_cutoff"), F.when(F.dayofmonth("d") == 13, read(2)).otherwise(read(1)).alias("series_cutoff"))
    got = D.dual_horizon(decisions, snapshots(series, dates), series, most=MOST)
    exact = ("strategic_score", "tactical_score", "confidence", "shadow_exposure", "raw_latent", "smooth_latent")
    return got.select(*[F.round(c, 6).alias(c) if c in exact else c for c in got.columns])
