"""Paged sources with faults, and write-once files with their manifests."""

import datetime
import glob
import json
import os

import pytest
from pyspark.errors import PySparkException

from kairoscope.sources import paged, verified

FIRST, LAST = datetime.date(2020, 1, 1), datetime.date(2020, 3, 31)
ROWS = [("a b", FIRST + datetime.timedelta(i), FIRST + datetime.timedelta(i + 3), i / 3 if i % 9 else None) for i in range(60)] + [("c", FIRST, LAST, 1e-12)]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    spark.dataSource.register(paged.PagedVintages)
    path = f"file://{tmp_path_factory.mktemp('pages')}/p"
    paged.record_pages(spark.createDataFrame(ROWS, "series_id string, obs_date date, vintage_date date, value double"), path, first=FIRST, last=LAST, window_days=20, page_rows=7)
    return path


def load(spark, path, **options):
    options = {"path": path, "series": json.dumps(["a b", "c"]), "first": str(FIRST), "last": str(LAST), "window_days": "20"} | options
    return spark.read.format("paged_vintages").options(**options).load()


@pytest.mark.parametrize("faults", ["0", "2"])
def test_pages_come_back_whole(spark, pages, faults):
    got = load(spark, pages, faults=faults)
    assert got.rdd.getNumPartitions() == 2 * len(paged.windows(FIRST, LAST, 20))
    assert sorted(map(tuple, got.collect())) == sorted(r for r in ROWS if r[3] is not None)


@pytest.mark.parametrize("options", [{"faults": "3"}, {"faults": "1", "budget": "1"}, {"series": '["a b", "unknown"]'}])
def test_a_page_that_cannot_be_had_fails(spark, pages, options):
    with pytest.raises(PySparkException):
        load(spark, pages, **options).collect()


def test_windows_cover_each_day_once():
    cut = paged.windows(FIRST, LAST, 20)
    assert [d for a, b in cut for d in (a + datetime.timedelta(i) for i in range((b - a).days + 1))] == [FIRST + datetime.timedelta(i) for i in range((LAST - FIRST).days + 1)]
    assert paged.windows(LAST, FIRST, 20) == [] and paged.windows(FIRST, FIRST, 20) == [(FIRST, FIRST)]


def answers(*statuses):
    left = list(statuses)

    def get(url):
        status = left.pop(0)
        if isinstance(status, Exception):
            raise status
        return status, url

    return get, left


@pytest.mark.parametrize(
    ("statuses", "attempts", "status", "waits"),
    [([200], 3, 200, 0), ([503, 429, 200], 3, 200, 2), ([500, 500, 500, 200], 3, 500, 2), ([404, 200], 3, 404, 0), ([OSError("lost"), 200], 3, 200, 1), ([500] * 9, 99, 500, 4), ([500, 200], 0, 500, 0)],
)
def test_requests_are_tried_again_within_bounds(statuses, attempts, status, waits):
    get, _ = answers(*statuses)
    slept = []
    assert paged.fetch(get, "u", attempts=attempts, sleep=slept.append, draw=lambda: 0.5) == (status, "u")
    assert slept == [0.05 * 2**i for i in range(waits)]


def test_other_requests_fail():
    get, _ = answers(OSError("lost"), OSError("gone"))
    with pytest.raises(OSError, match="gone"):
        paged.fetch(get, "u", attempts=2, sleep=lambda s: None)
    with pytest.raises(ValueError, match="GET"):
        paged.fetch(get, "u", method="POST")
    budget = paged.Budget(2)
    get, left = answers(500, 500, 200)
    with pytest.raises(paged.BudgetSpent):
        paged.fetch(get, "u", budget=budget, sleep=lambda s: None)
    assert budget.used == 2 and left == [200]
    assert paged.delay(10, 2.0) == paged.MAX_DELAY and paged.delay(1, -1) == 0


# ---------------------------------------------------------------- write-once files


@pytest.fixture
def written(spark, tmp_path):
    rows = [(s, FIRST + datetime.timedelta(i), float(i)) for s in "xyz" for i in range(50)]
    path = f"{tmp_path}/v"
    verified.write_once(spark.createDataFrame(rows, "series_id string, d date, v double").repartition(3), f"file://{path}")
    return path


def found(spark, path):
    return {r["issue"] for r in verified.issues(spark, f"file://{path}").collect()}


def test_files_are_read_as_written(spark, written):
    assert verified.read_verified(spark, f"file://{written}").count() == 150 and found(spark, written) == set()
    with pytest.raises(PySparkException, match="exists"):
        verified.write_once(spark.createDataFrame([("x", FIRST, 1.0)], "series_id string, d date, v double"), f"file://{written}")
    assert verified.read_verified(spark, f"file://{written}").count() == 150


def test_a_changed_byte_is_refused(spark, written):
    file = glob.glob(f"{written}/data/*.parquet")[0]
    data = bytearray(open(file, "rb").read())
    data[len(data) // 2] ^= 1
    with open(file, "wb") as out:
        out.write(data)
    os.remove(f"{os.path.dirname(file)}/.{os.path.basename(file)}.crc")  # a local check sum that other stores lack
    assert found(spark, written) == {"FILE_CHANGED"}
    with pytest.raises(verified.Refused, match="FILE_CHANGED"):
        verified.read_verified(spark, f"file://{written}")


def test_lost_and_added_files_are_refused(spark, written):
    files = glob.glob(f"{written}/data/*.parquet")
    os.rename(files[0], f"{written}/data/other.parquet")
    assert found(spark, written) == {"FILE_GONE", "FILE_ADDED"}


def test_rows_are_held_against_the_manifest(spark):
    rows = lambda *r: spark.createDataFrame([(s, FIRST + datetime.timedelta(i), v) for s, i, v in r], "series_id string, d date, v double")
    good = rows(("x", 0, 1.0), ("x", 1, 2.0))
    told = verified.series_manifest(good)
    issues = lambda r: {x["issue"] for x in verified.row_issues(r, told).collect()}
    assert issues(good) == set() and issues(rows(("x", 1, 2.0), ("x", 0, 1.0))) == set()
    assert issues(rows(("x", 0, 1.0))) == {"ROW_COUNT"}
    assert issues(rows(("x", 0, 1.0), ("x", 2, 2.0))) == {"RANGE"}
    assert issues(rows(("x", 0, 1.0), ("x", 1, 2.5))) == {"DIGEST"}
    assert issues(rows(("y", 0, 1.0), ("y", 1, 2.0))) == {"SERIES_GONE", "SERIES_ADDED"}
    assert "REPEATED_DATE" in issues(rows(("x", 0, 1.0), ("x", 0, 2.0))) and "NOT_FINITE" in issues(rows(("x", 0, 1.0), ("x", 1, float("nan"))))


# ---------------------------------------------------------------- wide vintages


@pytest.mark.parametrize(
    ("row", "what"), [({"date": "2020-01-01", "X_20200103": "1.5", "note": "x"}, "unknown vintage column: note"), ({"date": "2020-01-01", "X_20200230": "1"}, "unknown vintage column"), ({"date": "2020-13-01", "X_20200103": "1"}, "invalid observation date")]
)
def test_unknown_columns_of_wide_vintages_are_refused(spark, row, what):
    from kairoscope.sources.readers import wide_vintages

    payload = lambda r: spark.createDataFrame([("X", json.dumps({"observations": [r]}))], "series_id string, payload string")
    with pytest.raises(PySparkException, match=what):
        wide_vintages(payload(row)).collect()
    good = wide_vintages(payload({"date": "2020-01-01", "X_20200103": "1.5", "X_20200104": "."})).collect()
    assert [tuple(r) for r in good] == [("X", FIRST, FIRST + datetime.timedelta(2), 1.5)]
