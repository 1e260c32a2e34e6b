"""Snapshots from raw series."""

import datetime

import pytest

from kairoscope import params as P
from kairoscope.operators.snapshot import snapshots

DAY = datetime.date(2024, 7, 24)


def weekly(start, step, count=30):
    return [(datetime.date(2024, 1, 3) + datetime.timedelta(7 * i), start + i * step) for i in range(count)]


def daily(start, step=0.0, count=206):
    return [(datetime.date(2024, 1, 1) + datetime.timedelta(i), start + i * step) for i in range(count)]


COMPLETE = {
    "WALCL": weekly(6000, 15), "WDTGAL": weekly(700, 1), "WRBWFRBL": weekly(3200, 8), "RRPONTSYD": daily(500, -0.4), "RPONTSYD": daily(0),
    "SOFR": daily(5.3, -0.0002), "IORB": daily(5.4), "BAMLH0A0HYM2": daily(3.8, -0.001), "DGS10": daily(4.2, 0.001), "VIXCLS": daily(14),
    "DTWEXBGS": daily(120, 0.01), "SP500": daily(5000, 1), "T10Y2Y": daily(0.3, 0.001),
}
CASES = {
    "golden": ({}, DAY),
    "no_walcl_since": ({"WALCL": weekly(6000, 15, 5)}, DAY),
    "stale_treasury": ({"WDTGAL": weekly(700, 1, 28)}, DAY),
    "stale_repo": ({"RRPONTSYD": daily(500, -0.4, 198)}, DAY),
    "short": ({"WALCL": weekly(6000, 15, 13)}, weekly(0, 0, 13)[-1][0]),
    "no_credit": ({"BAMLH0A0HYM2": []}, DAY),
    "old_sofr": ({"SOFR": [x for x in daily(5.3, -0.0002) if x[0] <= datetime.date(2024, 7, 22)]}, DAY),
    "no_funding": ({"SOFR": [], "IORB": []}, DAY),
    "thin_treasury": ({"WALCL": weekly(6000, 15, 14), "WDTGAL": [weekly(700, 1)[0], weekly(700, 1)[13]], "RRPONTSYD": [(weekly(0, 0)[0][0], 500.0), (weekly(0, 0)[13][0], 450.0)]}, weekly(0, 0)[13][0]),
    "gap": ({"WALCL": [x for i, x in enumerate(weekly(6000, 15)) if i != 25]}, DAY),
    "dollar_gap": ({"DTWEXBGS": [x for i, x in enumerate(daily(120, 0.01)) if not 100 <= i < 105]}, DAY),
    "short_credit": ({"BAMLH0A0HYM2": daily(3.8, -0.001)[-10:]}, DAY),
}


@pytest.fixture(scope="module")
def made(spark):
    series = [(case, s, d, float(v)) for case, (change, _) in CASES.items() for s, rows in (COMPLETE | change).items() for d, v in rows]
    rows = spark.createDataFrame(series, "case string, series_id string, d date, v double")
    dates = spark.createDataFrame([(case, day, "BEARISH") for case, (_, day) in CASES.items()], "case string, d date, before string")
    return {r["case"]: r for r in snapshots(rows, dates, keys=["case"], previous="before").collect()}


def test_golden_snapshot(made):
    r = made["golden"]
    assert r["score"] == pytest.approx(54.46193058252426, abs=1e-11) and r["coverage"] == 1.0
    assert (r["verdict"], r["decision_status"], r["reason"]) == ("BEARISH", "OK", "Fed 扩表、净流动性在升 → 环境偏空")
    scores = {"trend": 63.4, "impulse": 80, "credit": 91.45300970873788, "funding": 100, "rates": 48, "dollar": 0, "vol": 800 / 9, "reserve": 71.8, "curve": 51.791666666666664}
    assert {k: v["score"] for k, v in r["factors"].items()} == pytest.approx(scores, abs=1e-9)
    assert all(v["status"] == "OK" and v["quality"] == 1.0 for v in r["factors"].values())
    assert [r[p] for p in ("p0", "p1", "p2", "p3")] == [False, True, False, True]
    assert set(r["freshness"]) == set(P.SERIES) and r["freshness"]["ECBASSETSW"]["status"] == "MISSING"
    assert r["factors"]["trend"]["extra"] == {"history_observations": 14.0, "cadence_observations": 14.0}


@pytest.mark.parametrize(
    ("case", "factor", "status"),
    [
        ("no_walcl_since", "trend", "STALE"), ("stale_treasury", "trend", "STALE"), ("stale_repo", "trend", "STALE"), ("short", "trend", "MISSING"),
        ("short", "impulse", "MISSING"), ("thin_treasury", "trend", "MISSING"), ("gap", "trend", "MISSING"), ("gap", "impulse", "MISSING"),
        ("no_credit", "credit", "MISSING"), ("no_funding", "reserve", "PARTIAL"), ("no_funding", "funding", "MISSING"), ("dollar_gap", "dollar", "MISSING"),
        ("short_credit", "credit", "PARTIAL"),
    ],
)
def test_factors_fail_closed(made, case, factor, status):
    r = made[case]
    got = r["factors"][factor]
    assert got["status"] == status and (got["score"] is None) == (status != "PARTIAL")
    assert got["quality"] == (0.5 if status == "PARTIAL" else 0.0)
    if factor == "trend":
        assert (r["decision_status"], r["score"], r["verdict"]) == ("DATA_INCOMPLETE", None, None)


def test_weights_are_renormalised(made):
    r = made["no_credit"]
    left = {k: w for k, w in P.WEIGHTS.items() if w > 0 and k != "credit"}
    assert r["score"] == pytest.approx(sum(r["factors"][k]["score"] * w for k, w in left.items()) / sum(left.values()), abs=1e-9)
    assert r["coverage"] == pytest.approx(7 / 8) and r["factors"]["credit"]["as_of"] is None


def test_factors_have_the_oldest_date(made):
    day = datetime.date(2024, 7, 22)
    assert made["old_sofr"]["factors"]["funding"]["as_of"] == made["old_sofr"]["factors"]["reserve"]["as_of"] == day
    assert made["old_sofr"]["factors"]["funding"]["components"]["IORB"]["date"] == DAY
    assert made["no_funding"]["factors"]["reserve"]["as_of"] == weekly(0, 0)[-1][0]
