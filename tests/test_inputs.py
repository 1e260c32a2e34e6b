"""Gates of raw histories, stored decisions and ledgers."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from kairoscope.operators import gates
from kairoscope.plans import inputs
from kairoscope.sources import readers

LEDGER = "ledger string, place long, id string, supersedes string, directions int, windows int, parameters int"


def test_ledgers_refer_backwards(spark):
    rows = [
        ("good", 1, "a", None, 1, 1, 1), ("good", 2, "b", "a", 2, 1, 1), ("good", 3, "c", "b", 1, 1, 1),
        ("cycle", 1, "a", "b", 1, 1, 1), ("cycle", 2, "b", "a", 1, 1, 1),
        ("odd", 1, "a", "a", 1, 1, 1), ("odd", 2, "b", "x", 1, 1, 1), ("odd", 3, "b", None, 1, 1, 1), ("odd", 4, "", None, 1, 1, 1), ("odd", 5, "c", None, 0, 1, 1), ("odd", 6, "d", None, 1, None, 1), ("odd", 7, None, None, 1, 1, 1),
    ]
    got = {(r["ledger"], r["place"]): r["issue"] for r in gates.ledger_issues(spark.createDataFrame(rows, LEDGER), ["ledger"]).collect()}
    assert [got["good", i] for i in (1, 2, 3)] == [None] * 3
    assert [got["cycle", i] for i in (1, 2)] == ["FORWARD_REFERENCE", None]  # a cycle has a forward reference
    assert [got["odd", i] for i in range(1, 8)] == ["REFERS_TO_ITSELF", "UNKNOWN_REFERENCE", "REPEATED_ID", "MISSING_ID", "INVALID_COUNT", "INVALID_COUNT", "MISSING_ID"]


def test_a_ledger_digest_tells_order_and_content(spark):
    rows = [("x", 1, "a", None, 1, 1, 1), ("x", 2, "b", "a", 1, 1, 1)]
    digest = lambda rows: gates.ledger_digest(spark.createDataFrame(rows, LEDGER), ["ledger"]).first()["digest"]
    first = digest(rows)
    assert digest(rows[::-1]) == first
    assert len({first, digest([(*rows[0][:2], "b", *rows[0][3:]), (*rows[1][:2], "a", *rows[1][3:])]), digest([rows[0], (*rows[1][:4], 2, 1, 1)]), digest(rows[:1])}) == 4


def history(weeks=80, start=datetime.date(2020, 1, 1), **change):
    """Four complete series from a Wednesday on, by name."""
    days = [start + datetime.timedelta(i - 20) for i in range(7 * weeks + 20)]
    wednesdays = [start + datetime.timedelta(7 * i) for i in range(weeks)]
    return {"WALCL": wednesdays, "WDTGAL": wednesdays, "WTREGEN": wednesdays, "RRPONTSYD": days} | change


GOOD = history()
LAST = GOOD["WALCL"][-1]
DECISION = LAST + datetime.timedelta(9)
CASES = {
    "good": (GOOD, None),
    "empty": (history(WALCL=[]), "TOO_FEW_ANCHORS"),
    "few": (history(weeks=66), None),
    "too_few": (history(weeks=65), "TOO_FEW_ANCHORS"),
    "cadence": (history(WALCL=GOOD["WALCL"][:50] + GOOD["WALCL"][51:]), "ANCHOR_CADENCE"),
    "weekday": (history(WALCL=[d + datetime.timedelta(i == 40) for i, d in enumerate(GOOD["WALCL"])]), "ANCHOR_WEEKDAY"),
    "treasury": (history(WDTGAL=[d for i, d in enumerate(GOOD["WDTGAL"]) if i != 30]), "TREASURY_DATE_MISSING"),
    "average": (history(WTREGEN=[d for i, d in enumerate(GOOD["WTREGEN"]) if i != 30]), "TREASURY_AVERAGE_STALE"),
    "average_cadence": (history(WTREGEN=[d - datetime.timedelta(6 * (i == 30)) for i, d in enumerate(GOOD["WTREGEN"])]), "TREASURY_AVERAGE_CADENCE"),
    "repo": (history(RRPONTSYD=[d for i, d in enumerate(GOOD["RRPONTSYD"]) if not 100 <= i < 106]), "REPO_WINDOW"),
    "invalid": (GOOD, "INVALID_SERIES"),
    "old_gap": (history(weeks=240, WALCL=(w := history(weeks=240)["WALCL"])[:20] + w[21:]), None),  # further back than the last 170 anchors
}


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(case, s, d, math.nan if (case, s, i) == ("invalid", "WDTGAL", 3) else 1.0) for case, (series, _) in CASES.items() for s, days in series.items() for i, d in enumerate(days)]
    at = {case: (series["WALCL"] or GOOD["WALCL"])[-1] + datetime.timedelta(9) for case, (series, _) in CASES.items()}
    series = spark.createDataFrame(rows, "book string, series_id string, d date, v double")
    return {r["book"]: r for r in gates.raw_smooth_gate(spark.createDataFrame(list(at.items()), "book string, d date"), series, ["book"]).collect()}


@pytest.mark.parametrize("case", sorted(CASES))
def test_raw_and_smooth_history(judged, case):
    assert judged[case]["reason"] == CASES[case][1]
    if CASES[case][1] is None:
        assert judged[case]["n_anchors"] == min(170, len(CASES[case][0]["WALCL"]))


def test_the_latest_anchor_is_fresh(spark):
    series = spark.createDataFrame([(s, d, 1.0) for s, days in GOOD.items() for d in days], "series_id string, d date, v double")
    dates = spark.createDataFrame([(LAST + datetime.timedelta(k),) for k in (9, 11)], "d date")
    assert [r["reason"] for r in gates.raw_smooth_gate(dates, series, []).orderBy("d").collect()] == [None, "STALE_ANCHOR"]


def test_each_field_refuses_its_row(spark):
    sf = "/root/testdata/sf0.001"
    rows = readers.decision_rows(inputs.stored_decisions(spark, sf), F.lit("2003-01-01").cast("timestamp")).collect()
    wanted = {inputs._ISSUE_OF.get(f, f) for f in inputs.FLAWS}
    assert {r["issue"] for r in rows} == {None, "INVALID_JSON", *wanted}
    odd = spark.createDataFrame([(None,), ("",), ("[]",), ("3",)], "payload string")
    assert {r["issue"] for r in readers.decision_rows(odd, F.lit("2003-01-01").cast("timestamp")).collect()} <= {"INVALID_JSON", "date"}
