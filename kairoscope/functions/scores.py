"""Scores, bands and decisions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P
from .scalars import _c, clamp, lin_map


def _or(x, default: float) -> Column:
    return F.coalesce(_c(x), F.lit(float(default)))


def net_liquidity(assets, treasury, repo) -> Column:
    return _c(assets) - _c(treasury) - _c(repo)


def impulse_label(now, before) -> Column:
    """EXPANDING, CONTRACTING or FLAT by a step of 50; FLAT without history."""
    d = _c(now) - _c(before)
    return F.when(d > P.IMPULSE_STEP, "EXPANDING").when(d < -P.IMPULSE_STEP, "CONTRACTING").otherwise("FLAT")


def impulse_score(label) -> Column:
    label = _c(label)
    return F.when(label == "EXPANDING", 80.0).when(label == "CONTRACTING", 30.0).otherwise(55.0)


def trend_score(level, sma, four_back, thirteen_back) -> Column:
    """Half from the side of the mean (60 or 40), half from the four-step slope; 50 with under 14 points."""
    level = _c(level)
    blend = F.when(level > _c(sma), 60.0).otherwise(40.0) * 0.5 + lin_map(level - _c(four_back), -200, 200) * 0.5
    return F.when(_c(sma).isNull() | _c(thirteen_back).isNull(), 50.0).otherwise(blend)


def direction(level, sma) -> Column:
    """UP, DOWN or FLAT by the gap to the mean relative to max(1, |mean|)."""
    gap = (_c(level) - _c(sma)) / F.greatest(F.lit(1.0), F.abs(_c(sma)))
    return F.when(gap > P.DIRECTION_GAP, "UP").when(gap < -P.DIRECTION_GAP, "DOWN").otherwise("FLAT")


def credit_score(share, change) -> Column:
    """0.55 level (low spread rank is good) and 0.45 momentum, less 15 when fragile."""
    share, change = _c(share), _c(change)
    fragile = F.when((share < 0.15) & (change > 0.20), 15.0).otherwise(0.0)
    return clamp((1.0 - share) * 100.0 * 0.55 + _or(lin_map(change, 1.0, -0.25), 50) * 0.45 - fragile)


def available_credit_score(share, change) -> Column:
    return F.when(_c(change).isNull(), clamp((1.0 - _c(share)) * 100.0)).otherwise(credit_score(share, change))


def funding_score(spread) -> Column:
    return lin_map(spread, 0.10, 0)


def rates_score(change) -> Column:
    return _or(lin_map(change, 0.5, -0.5), 50)


def dollar_score(value, mean, sd, n) -> Column:
    """Population z over 200 rows, +1 bad; 50 with fewer rows, z 0 without spread."""
    z = F.when(_c(sd) == 0, 0.0).otherwise(F.try_divide(_c(value) - _c(mean), _c(sd)))
    return F.when(_c(n) < 200, 50.0).otherwise(lin_map(z, 1, -1))


def vol_score(x) -> Column:
    return _or(lin_map(x, 30, 12), 50)


def reserve_score(level, change, funding) -> Column:
    return _or(lin_map(level, 2800, 3800), 50) * 0.5 + _or(lin_map(change, -300, 300), 50) * 0.3 + _or(funding, 50) * 0.2


def available_score(parts: dict[float, Column] | list[tuple[float, Column]]) -> Column:
    """Weighted mean over the parts that are not null; null if none is."""
    pairs = parts.items() if isinstance(parts, dict) else parts
    top, bottom = F.lit(0.0), F.lit(0.0)
    for weight, x in pairs:
        top = top + F.coalesce(_c(x) * float(weight), F.lit(0.0))
        bottom = bottom + F.when(_c(x).isNotNull(), float(weight)).otherwise(0.0)
    return F.try_divide(top, F.when(bottom > 0, bottom))


def available_reserve_score(level, change, funding) -> Column:
    return available_score([(0.5, lin_map(level, 2800, 3800)), (0.3, lin_map(change, -300, 300)), (0.2, _c(funding))])


def curve_score(level, change) -> Column:
    return _or(lin_map(level, -0.5, 1.5), 50) * 0.5 + _or(lin_map(change, -0.3, 0.3), 50) * 0.5


def available_curve_score(level, change) -> Column:
    return F.when(_c(change).isNull(), lin_map(level, -0.5, 1.5)).otherwise(curve_score(level, change))


def weighted_score(factors: dict[str, Column]) -> Column:
    """Sum of weight x factor without renormalising, held in 0..100; null if a factor is."""
    out = F.lit(0.0)
    for name, weight in P.WEIGHTS.items():
        if weight > 0:
            out = out + _c(factors[name]) * weight
    return clamp(out)


def band(score) -> Column:
    """BULLISH above 55, BEARISH below 45, null between and for null."""
    score = _c(score)
    return F.when(score > P.BULL_ABOVE, "BULLISH").when(score < P.BEAR_BELOW, "BEARISH")


def downgrade(verdict) -> Column:
    verdict = _c(verdict)
    return F.when(verdict == "BULLISH", "NEUTRAL").when(verdict.isin("NEUTRAL", "BEARISH"), "BEARISH")


def policy_label(d, impulse) -> Column:
    i = _c(impulse)
    by_impulse = F.when(i == "EXPANDING", "QE").when(i == "CONTRACTING", "QT").otherwise("NEUTRAL")
    return F.when(_c(d) >= F.lit(P.POLICY_SWITCH).cast("date"), "RESERVE_MGMT").otherwise(by_impulse)


def vix_stress(vix) -> Column:
    """The snapshot's proxy: at least 28 is stress, null is unknown."""
    return F.when(_c(vix).isNull(), "UNKNOWN").when(_c(vix) >= P.VIX_STRESS, "STRESSED").otherwise("NORMAL")


def display_verdict(verdict, score, stress, status) -> Column:
    """Unknown data or stress shows UNKNOWN; stress below a score of 65 shows one grade less."""
    known = (_c(status) == "OK") & _c(score).isNotNull() & (_c(stress) != "UNKNOWN")
    stressed = (_c(stress) == "STRESSED") & (_c(score) < P.STRESS_CEILING)
    return F.when(~known | known.isNull(), "UNKNOWN").when(stressed, downgrade(verdict)).otherwise(_c(verdict))


def base_exposure(verdict, direction_, score) -> Column:
    """Bullish 1.0, or 0.9 with liquidity down; bearish 0.25; neutral 0.75 from score 50 on, or else 0.5."""
    v, e = _c(verdict), P.EXPOSURES
    return (
        F.when((v == "BULLISH") & (_c(direction_) == "DOWN"), e["high"]).when(v == "BULLISH", e["full"])
        .when(v == "BEARISH", e["low"]).when(_c(score) < P.NEUTRAL, e["cautious"]).otherwise(e["middle"])
    )


def exposure(verdict, direction_, score, stress) -> Column:
    base = base_exposure(verdict, direction_, score)
    stressed = (_c(stress) == "STRESSED") & (_c(score) < P.STRESS_CEILING)
    return F.when(stressed, P.EXPOSURES["low"]).when((_c(stress) == "UNKNOWN") & (base > P.EXPOSURES["middle"]), P.EXPOSURES["middle"]).otherwise(base)


def logistic_score(gap, impulse4, impulse13) -> Column:
    w = P.CHALLENGER
    latent = _c(gap) * w["gap"] + _c(impulse4) * w["impulse4"] + _c(impulse13) * w["impulse13"]
    return F.lit(100.0) / (F.exp(-latent) + 1.0)


def sign_class(x) -> Column:
    x = _c(x)
    return F.when(x.isNull(), "MISSING").when(x > 0, "UP").when(x < 0, "DOWN").otherwise("FLAT")


def agreement(a, b) -> Column:
    """HIGH for equal directions, LOW for opposite ones, TRANSITION for flat or missing."""
    a, b = _c(a), _c(b)
    moving = a.isin("UP", "DOWN") & b.isin("UP", "DOWN")
    return F.when(~moving, "TRANSITION").when(a == b, "HIGH").otherwise("LOW")


def reserve_state(score) -> Column:
    s = _c(score)
    return (
        F.when(s.isNull() | F.isnan(s), "UNKNOWN").when(s >= 80, "ABUNDANT").when(s >= 60, "AMPLE")
        .when(s >= 40, "TRANSITION").when(s >= 20, "SCARCE").otherwise("STRESSED")
    )


def shadow_exposure(base, tactical, confidence) -> Column:
    """One step of 0.10 at 60 and 40; up needs confidence 60; held in 0.25..1, and to 0.75 below confidence 40."""
    t, c = _c(tactical), _c(confidence)
    step = F.when((t >= 60) & (c >= 60), 0.10).when(t <= 40, -0.10).otherwise(0.0)
    held = clamp(_c(base) + step, 0.25, 1.0)
    return F.when(c < 40, F.least(held, F.lit(0.75))).otherwise(held)


def yield_scale(x) -> Column:
    return F.when(_c(x) > 20, _c(x) / 10.0).otherwise(_c(x))


# Score of a policy regime (row) for an expanding, flat or contracting balance sheet.
POLICY_MATRIX = {
    "QE": (80.0, 60.0, 40.0),
    "QT": (50.0, 40.0, 30.0),
    "RESERVE_MANAGEMENT": (57.5, 52.5, 42.5),
    "REINVESTMENT_ONLY": (52.5, 50.0, 45.0),
    "NEUTRAL": (55.0, 50.0, 45.0),
}


def policy_score(regime, impulse) -> Column:
    """struct(status, score): crisis and unknown regimes have no score."""
    regime, i = _c(regime), _c(impulse)
    status = F.when(regime == "CRISIS_LIQUIDITY", "CRISIS_POLICY_SEPARATE").when(regime.isin(*POLICY_MATRIX), "OK").otherwise("POLICY_UNAVAILABLE")
    score = F.lit(None).cast("double")
    for name, (up, flat, down) in POLICY_MATRIX.items():
        score = F.when(regime == name, F.when(i == "EXPANDING", up).when(i == "FLAT", flat).when(i == "CONTRACTING", down)).otherwise(score)
    return F.struct(status.alias("status"), score.alias("score"))


def guidance_tone(verdict, direction_, score, stress) -> Column:
    """unknown, brake, bull, bear or neutral; stress comes first, then the bands."""
    v, stressed = _c(verdict), (_c(stress) == "STRESSED") & (_c(score) < P.STRESS_CEILING)
    return (
        F.when(_c(stress) == "UNKNOWN", "unknown").when(stressed, "brake").when((v == "BULLISH") & (_c(direction_) == "DOWN"), "neutral")
        .when(v == "BULLISH", "bull").when(v == "BEARISH", "bear").otherwise("neutral")
    )


def divergence(impulse, direction_) -> Column:
    """The balance sheet and net liquidity move apart."""
    i, d = _c(impulse), _c(direction_)
    return F.when((i == "EXPANDING") & (d == "DOWN"), "EXPANDING_BUT_DRAINING").when((i == "CONTRACTING") & (d == "UP"), "CONTRACTING_BUT_ADDING")


def bear_trigger_armed(score) -> Column:
    return (_c(score) < P.BEAR_BELOW) | (_c(score) - P.BEAR_BELOW <= P.ARM_DISTANCE)


def factor_agreement(up, down, n: int = 4) -> Column:
    """Share of major factors on the stronger side, neutral ones counted half, in percent."""
    rest = F.lit(float(n)) - _c(up) - _c(down)
    return F.greatest(_c(up) + rest * 0.5, _c(down) + rest * 0.5) * 100.0 / n


def confidence(completeness, freshness, sample, agreement_, raw_smooth) -> Column:
    """Mean of five components; the sample counts fully from 52, raw and smooth by 100, 50, 0."""
    s = F.least(F.lit(100.0), _c(sample) / 52.0 * 100.0)
    r = F.when(_c(raw_smooth) == "HIGH", 100.0).when(_c(raw_smooth) == "LOW", 0.0).otherwise(50.0)
    return (_c(completeness) + _c(freshness) + s + _c(agreement_) + r) / 5.0


def candidate_verdict(ic, low, high, p, delta, residual, n, sign: int) -> Column:
    """PASS, DISPLAY-ONLY or DROP; a candidate of negative sign is judged turned round."""
    o_ic = _c(ic) * float(sign)
    o_low, o_p = (_c(low), _c(p)) if sign > 0 else (-_c(high), F.lit(1.0) - _c(p))
    robust = (o_low > 0) | ((o_p < 0.10) & (o_ic > 0))
    adds = (_c(delta) > 0.003) | (F.abs(_c(residual)) > 0.05)
    shown = (F.abs(_c(ic)) > 0.05) | (F.abs(_c(residual)) > 0.05)
    return F.when(robust & adds & (_c(n) >= 10), "PASS").when(shown, "DISPLAY-ONLY").otherwise("DROP")
