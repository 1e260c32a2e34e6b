"""The second horizon: a four-week view beside a snapshot, with a measured confidence.

Everything that a week needs of its past (raw and smooth levels, their latents,
the last five levels) is made once for each weekly row by windows. A decision
looks up its snapshot and its weekly rows by as-of joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import params as P
from ..functions import scores as C
from ..functions.scalars import clamp
from . import windows as N
from .asof import asof_last, fresh
from .gates import ANCHOR, AVAILABLE_DAYS, AVERAGE, REPO, REPO_ROWS, TREASURY, WEEK_DAYS, raw_smooth_gate
from .snapshot import COVERED, net_levels

# Factors that must agree, weeks of the tactical view, scores of a factor's freshness, most snapshots of a request.
MAJOR = ("trend", "dollar", "reserve", "curve")
TACTICAL_ROWS = 5
FRESHNESS = {"OK": 100.0, "PARTIAL": 50.0, "STALE": 0.0, "MISSING": 0.0}
MOST_SNAPSHOTS = 600


def raw_smooth_track(series: DataFrame, keys: list[str]) -> DataFrame:
    """keys, d, raw and smooth levels, their latents, and agreement (HIGH, LOW, TRANSITION) of each weekly anchor that has all its series."""
    of = lambda s: series.where(F.col("series_id") == s).select(*keys, "d", "v")
    order = W.partitionBy(*keys).orderBy("d")
    days = W.partitionBy(*keys).orderBy(F.unix_date("d")).rangeBetween(-WEEK_DAYS, 0)
    anchors = of(ANCHOR).join(of(TREASURY).withColumnRenamed("v", "t"), [*keys, "d"])
    # anchors and the average's rows in one order: the frame of an anchor holds the rows of its own seven days
    week = anchors.select(*keys, "d", F.lit(None).cast("double").alias("v"), F.lit(True).alias("anchor")).unionByName(of(AVERAGE).withColumn("anchor", F.lit(False)))
    week = week.withColumn("week", F.avg("v").over(days)).where("anchor").select(*keys, "d", "week")
    five = order.rowsBetween(1 - REPO_ROWS, 0)
    repo = of(REPO).select("*", F.avg("v").over(five).alias("mean"), F.count("v").over(five).alias("n"))
    rows = asof_last(anchors.join(week, [*keys, "d"]), repo, keys=keys, carry=["v", "mean", "n"], prefix="r_")
    rows = rows.where(F.col("week").isNotNull() & (F.col("r_n") == REPO_ROWS))
    rows = rows.select(*keys, "d", (F.col("v") - F.col("t") - F.col("r_v")).alias("raw"), (F.col("v") - F.col("week") - F.col("r_mean")).alias("smooth"))
    for level in ("raw", "smooth"):
        parts = {"gap": F.col(level) - N.sma(level, P.TREND_WEEKS, keys), "impulse4": F.col(level) - N.lag(level, 4, keys), "impulse13": F.col(level) - N.lag(level, 13, keys)}
        for name, c in parts.items():
            rows = rows.withColumn(f"__{name}", c)
        for name in parts:
            rows = rows.withColumn(f"__m_{name}", N.prior_mad(f"__{name}", keys))
        latent = sum((F.col(f"__{n}") / F.col(f"__m_{n}") * w for n, w in P.CHALLENGER.items()), F.lit(0.0))
        rows = rows.withColumn(f"{level}_latent", latent).drop(*[c for n in parts for c in (f"__{n}", f"__m_{n}")])
    return rows.withColumn("agreement", C.agreement(C.sign_class("raw_latent"), C.sign_class("smooth_latent")))


def tactical_track(series: DataFrame, keys: list[str]) -> DataFrame:
    """keys, d and trend: the four-week trend score of the last five levels, null unless all are fresh and 5 to 10 days apart."""
    order = W.partitionBy(*keys).orderBy("d")
    five, four = order.rowsBetween(1 - TACTICAL_ROWS, 0), order.rowsBetween(2 - TACTICAL_ROWS, 0)
    low, high = P.CADENCE["WEEKLY"]
    rows = net_levels(series, keys)
    ok = (F.count("__net").over(five) == TACTICAL_ROWS) & (F.min("__gap").over(four) >= low) & (F.max("__gap").over(four) <= high)
    rows = rows.select(*keys, "d", "__net", F.first("__net").over(five).alias("back"), F.avg("__net").over(four).alias("mean"), ok.alias("ok"))
    return rows.select(*keys, "d", F.when(F.col("ok"), C.trend_score("__net", "mean", "back", F.lit(0.0))).alias("trend"))


def _status(name: str) -> Column:
    return F.col("s_factors")[name]["status"]


def _score(name: str) -> Column:
    return F.col("s_factors")[name]["score"]


def dual_horizon(decisions: DataFrame, snapshots: DataFrame, series: DataFrame, *, keys: list[str] = (), most: int = MOST_SNAPSHOTS) -> DataFrame:
    """``decisions`` (keys, d, and the cutoffs snapshot_cutoff and series_cutoff that its inputs were read at) with the second horizon.

    ``snapshots`` is what ``snapshot.snapshots`` gives. The first reason in order makes a
    decision DATA_INCOMPLETE; others have a tactical score, a confidence of five
    measured components, and an exposure one step at most from the snapshot's own.
    """
    keys = list(keys)
    order = W.partitionBy(*keys).orderBy("d")
    earlier = W.partitionBy(*keys, "impulse").orderBy("d").rowsBetween(W.unboundedPreceding, -1)
    formal = snapshots.select(
        *keys, "d", "score", "verdict", "direction", "impulse", "vix", "factors", F.row_number().over(order).alias("place"), F.count(F.lit(1)).over(earlier).alias("same_regime")
    )
    rows = asof_last(decisions, formal, keys=keys, carry=["score", "verdict", "direction", "impulse", "vix", "factors", "place", "same_regime"], prefix="s_")
    gate = raw_smooth_gate(decisions.select(*keys, "d"), series, keys).select(*keys, "d", F.col("reason").alias("gate"), "n_anchors")
    rows = rows.join(gate, [*keys, "d"]).withColumn("__at", F.date_sub("d", AVAILABLE_DAYS))
    rows = asof_last(rows, raw_smooth_track(series, keys), keys=keys, on="__at", data_on="d", carry=["raw_latent", "smooth_latent", "agreement"], prefix="c_")
    rows = asof_last(rows, tactical_track(series, keys), keys=keys, carry=["trend"], prefix="t_")
    _, _, calendar, business, _, _, fallback = P.SERIES[ANCHOR]
    recent = fresh(F.lit(0), F.col("t_date"), F.col("d"), calendar_days=calendar, business_days=business, fallback=F.lit(fallback))["status"] == "FRESH"
    whole = F.lit(True)
    for name in COVERED:
        whole = whole & F.coalesce(_score(name).between(0, 100), F.lit(False))
    known = F.lit(True)
    for name in COVERED:
        known = known & F.coalesce(_status(name).isin(*FRESHNESS), F.lit(False))
    latents = F.col("c_raw_latent").isNotNull() & F.col("c_smooth_latent").isNotNull()
    issue = (
        F.when(~F.col("snapshot_cutoff").eqNullSafe(F.col("series_cutoff")), "AS_OF_CUTOFF_MISMATCH").when(F.col("s_date").isNull(), "NO_GOVERNED_FORMAL_SNAPSHOT")
        .when(F.col("s_place") > most, "SNAPSHOT_WORK_LIMIT_EXCEEDED")
        .when(~F.coalesce(F.col("s_verdict").isin("BULLISH", "NEUTRAL", "BEARISH") & F.col("s_direction").isin("UP", "DOWN", "FLAT"), F.lit(False)), "FORMAL_SNAPSHOT_INVALID")
        .when(~whole, "MISSING_FORMAL_FACTOR_COHORT").when(F.col("gate").isNotNull() | ~latents, "MISSING_RAW_SMOOTH_HISTORY")
        .when(F.col("t_trend").isNull() | ~recent, "MISSING_TACTICAL_HISTORY").when(~known, "CONFIDENCE_INPUT_INCOMPLETE")
    )
    tactical = F.col("t_trend") * P.WEIGHTS["trend"]
    for name in COVERED:
        if name != "trend":
            tactical = tactical + _score(name) * P.WEIGHTS[name]
    rows = rows.withColumn("tactical", clamp(tactical))
    freshness = sum((F.coalesce(*[F.when(_status(n) == s, x) for s, x in FRESHNESS.items()]) for n in COVERED), F.lit(0.0)) / len(COVERED)
    side = lambda n: F.col("t_trend") if n == "trend" else _score(n)
    up = sum((F.when(side(n) > P.BULL_ABOVE, 1.0).otherwise(0.0) for n in MAJOR), F.lit(0.0))
    down = sum((F.when(side(n) < P.BEAR_BELOW, 1.0).otherwise(0.0) for n in MAJOR), F.lit(0.0))
    rows = rows.withColumn("confidence", C.confidence(F.lit(100.0), freshness, "s_same_regime", C.factor_agreement(up, down), "c_agreement"))
    base = C.exposure("s_verdict", "s_direction", "s_score", C.vix_stress("s_vix"))
    t, c = F.col("tactical"), F.col("confidence")
    told = F.concat_ws(
        ",", F.when(t >= 60, "TACTICAL_UP").when(t <= 40, "TACTICAL_DOWN").otherwise("TACTICAL_NEUTRAL"), F.when((t >= 60) & (c < 60), "UPWARD_ADJUSTMENT_BLOCKED_LOW_CONFIDENCE"),
        F.when(c < 40, "LOW_CONFIDENCE_EXPOSURE_CAP"), F.concat(F.lit("RAW_SMOOTH_"), "c_agreement"),
    )
    rows = rows.withColumn("issue", issue)
    ok = lambda x, name: F.when(F.col("issue").isNull(), x).alias(name)
    return rows.select(
        *keys, "d", F.when(F.col("issue").isNull(), "OK").otherwise("DATA_INCOMPLETE").alias("status"), F.coalesce("issue", told).alias("reasons"),
        ok(F.col("s_score"), "strategic_score"), ok(t, "tactical_score"), ok(c, "confidence"), ok(base, "base_exposure"), ok(C.shadow_exposure(base, t, c), "shadow_exposure"),
        ok(F.col("c_raw_latent"), "raw_latent"), ok(F.col("c_smooth_latent"), "smooth_latent"), ok(F.col("n_anchors"), "sample_count"),
    )
