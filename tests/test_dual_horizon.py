"""The second horizon: every refusal, and the caps of low confidence."""

import datetime
import math

import pytest

from kairoscope.operators.dual_horizon import dual_horizon, raw_smooth_track
from kairoscope.operators.snapshot import FACTORS

START = datetime.date(2019, 1, 2)
WEEKS = 200
WEDNESDAYS = [START + datetime.timedelta(7 * i) for i in range(WEEKS)]
DAY = WEDNESDAYS[-1] + datetime.timedelta(2)
DAYS = [START + datetime.timedelta(i - 20) for i in range(7 * WEEKS + 20)]
SERIES = {
    "WALCL": [(d, 6000 + 3 * i + 40 * math.sin(i / 5)) for i, d in enumerate(WEDNESDAYS)],
    "WDTGAL": [(d, 700 + 20 * math.cos(i / 7)) for i, d in enumerate(WEDNESDAYS)],
    "WTREGEN": [(d, 700 + 20 * math.cos(i / 7) + i % 3) for i, d in enumerate(WEDNESDAYS)],
    "RRPONTSYD": [(d, 300 + 10 * math.sin(i / 30)) for i, d in enumerate(DAYS)],
}
SCHEMA = "case string, d date, score double, verdict string, direction string, impulse string, vix double, factors map<string,struct<score:double,status:string>>"


def factors(status="OK", score=70.0, **change):
    return {n: (score, status) for n in FACTORS} | change


#: case: (snapshots as (days before, verdict, factors), series that are replaced, cutoffs are equal)
PLAIN = [(7 * k, "BULLISH", factors()) for k in range(60)]
#: Raw levels that rise ever faster, and a weekly average that takes more than that away.
RISING = {"WALCL": [(d, 6000 + 0.2 * i * i) for i, d in enumerate(WEDNESDAYS)]}
APART = {"WTREGEN": [(d, 700 + 0.5 * i * i) for i, d in enumerate(WEDNESDAYS)]}
CASES = {
    "good": (PLAIN, {}, True),
    "cutoffs": (PLAIN, {}, False),
    "none": ([], {}, True),
    "many": ([(k, "BULLISH", factors()) for k in range(101)], {}, True),
    "invalid": ([(0, None, factors()), *PLAIN[1:]], {}, True),
    "factors": ([(0, "BULLISH", factors(curve=(None, "MISSING"))), *PLAIN[1:]], {}, True),
    "history": (PLAIN, {"WDTGAL": SERIES["WDTGAL"][:150] + SERIES["WDTGAL"][151:]}, True),
    "tactical": (PLAIN, {"RRPONTSYD": [x for x in SERIES["RRPONTSYD"] if x[0] <= DAY - datetime.timedelta(7)]}, True),
    "status": ([(0, "BULLISH", factors(rates=(50.0, "ODD"))), *PLAIN[1:]], {}, True),
    "blocked": ([(0, "NEUTRAL", factors("STALE", dollar=(50.0, "STALE")))], RISING, True),
    "capped": ([(0, "BULLISH", factors("STALE", dollar=(30.0, "STALE"), curve=(30.0, "STALE")))], RISING | APART, True),
}
ISSUES = {
    "cutoffs": "AS_OF_CUTOFF_MISMATCH", "none": "NO_GOVERNED_FORMAL_SNAPSHOT", "many": "SNAPSHOT_WORK_LIMIT_EXCEEDED", "invalid": "FORMAL_SNAPSHOT_INVALID",
    "factors": "MISSING_FORMAL_FACTOR_COHORT", "history": "MISSING_RAW_SMOOTH_HISTORY", "tactical": "MISSING_TACTICAL_HISTORY", "status": "CONFIDENCE_INPUT_INCOMPLETE",
}


@pytest.fixture(scope="module")
def made(spark):
    series = [(case, s, d, float(v)) for case, (_, change, _) in CASES.items() for s, rows in (SERIES | change).items() for d, v in rows]
    formal = [(case, DAY - datetime.timedelta(k), 60.0, verdict, "UP", "FLAT", 15.0, f) for case, (rows, _, _) in CASES.items() for k, verdict, f in rows]
    cut = datetime.datetime(2030, 1, 1)
    decisions = [(case, DAY, cut, cut if same else datetime.datetime(2030, 1, 2)) for case, (_, _, same) in CASES.items()]
    got = dual_horizon(
        spark.createDataFrame(decisions, "case string, d date, snapshot_cutoff timestamp, series_cutoff timestamp"), spark.createDataFrame(formal, SCHEMA),
        spark.createDataFrame(series, "case string, series_id string, d date, v double"), keys=["case"], most=100,
    )
    return {r["case"]: r for r in got.collect()}


@pytest.mark.parametrize("case", sorted(ISSUES))
def test_refusals(made, case):
    r = made[case]
    assert (r["status"], r["reasons"], r["tactical_score"], r["shadow_exposure"]) == ("DATA_INCOMPLETE", ISSUES[case], None, None)


def test_a_whole_decision(made):
    r = made["good"]
    assert r["status"] == "OK" and r["sample_count"] == 170 and r["base_exposure"] == 1.0 and 0 <= r["tactical_score"] <= 100
    assert r["confidence"] >= 60 and r["shadow_exposure"] == 1.0  # at most 1


def test_low_confidence_blocks_and_caps(made):
    blocked, capped = made["blocked"], made["capped"]
    assert blocked["reasons"] == "TACTICAL_UP,UPWARD_ADJUSTMENT_BLOCKED_LOW_CONFIDENCE,RAW_SMOOTH_HIGH"
    assert blocked["confidence"] == pytest.approx((100 + 0 + 0 + 87.5 + 100) / 5) and blocked["shadow_exposure"] == blocked["base_exposure"] == 0.75
    assert capped["reasons"].endswith("LOW_CONFIDENCE_EXPOSURE_CAP,RAW_SMOOTH_LOW") and capped["raw_latent"] > 0 > capped["smooth_latent"]
    assert capped["confidence"] == pytest.approx((100 + 0 + 0 + 50 + 0) / 5) and (capped["base_exposure"], capped["shadow_exposure"]) == (1.0, 0.75)


def test_the_smooth_level_takes_the_days_of_its_week(spark):
    rows = [("WALCL", WEDNESDAYS[3], 1000.0), ("WDTGAL", WEDNESDAYS[3], 100.0)]
    rows += [("WTREGEN", WEDNESDAYS[3] - datetime.timedelta(k), v) for k, v in ((1, 90.0), (6, 110.0), (7, 900.0))]
    rows += [("RRPONTSYD", WEDNESDAYS[3] - datetime.timedelta(k), float(k)) for k in range(1, 8)]
    got = raw_smooth_track(spark.createDataFrame(rows, "series_id string, d date, v double"), []).collect()
    assert [(r["raw"], r["smooth"]) for r in got] == [(1000.0 - 100.0 - 1.0, 1000.0 - 100.0 - 3.0)]
