"""Activation as one commit: killed, replayed, contested."""

import datetime

import pytest
from pyspark.sql import functions as F

from kairoscope.sources import commits
from kairoscope.sources.sinks import CommitError

DAY = datetime.date(2024, 1, 2)
SERIES = ["SP500", "SOFR", "WALCL"]
DONE = "2024-02-01 00:00:00"
STEPS = ["attempts", "conflicts", "pit", "observations", "latest", "daily", "counted"]


class Clock:
    now = 1000.0

    def __call__(self):
        return self.now


@pytest.fixture
def store(spark, tmp_path):
    return commits.Store(spark, f"file://{tmp_path}/store", Clock())


def pit_rows(spark, rows):
    df = spark.createDataFrame([(s, d, v, x) for s, d, v, x in rows], "series_id string, obs_date date, vintage_date date, value double")
    return df.select("*", F.sha2(F.col("value").cast("string"), 256).alias("checksum"), F.lit("FEED").alias("source"), *[F.to_timestamp(F.lit("2024-01-20 00:00:00")).alias(c) for c in ("released_at", "fetched_at", "tradable_at")])


def prepared(store, run, value, *, day=DAY, vintage=DAY, pit=None, attempts=None):
    """Takes the lease and stages a run in which each series has ``value``."""
    spark = store.spark
    assert store.acquire(run, 100)
    store.start(run)
    store.stage(run, "pit", pit_rows(spark, [(s, day, vintage, value) for s in SERIES]) if pit is None else pit)
    store.stage(run, "observations", spark.createDataFrame([(s, day, value) for s in SERIES], "series_id string, d date, v double"))
    store.stage(run, "attempts", spark.createDataFrame(attempts or [(s, "SUCCEEDED", 1) for s in SERIES], "series_id string, status string, row_count long"))


def seen(store):
    """All that a reader can see."""
    out = {}
    for table in commits.TABLES:
        rows = store.read(table)
        out[table] = None if rows is None else sorted(map(str, rows.collect()))
    return out


def test_a_run_becomes_visible_at_once(store):
    prepared(store, "one", 1.0)
    assert seen(store) == dict.fromkeys(commits.TABLES)
    entry = store.activate("one", SERIES, DONE)
    assert (entry["row_count"], entry["series_count"]) == (3, 3) and store.states() == {"one": "ACTIVE"}
    assert sorted(r["symbol"] for r in store.read("daily").collect()) == ["SOFR", "SPX"]
    store.release("one")
    prepared(store, "two", 2.0, vintage=DAY + datetime.timedelta(1))
    store.activate("two", SERIES, DONE)
    assert store.states() == {"one": "SUPERSEDED", "two": "ACTIVE"}
    assert {r["v"] for r in store.read("observations").collect()} == {2.0} and store.read("pit").count() == 6 and store.read("daily").count() == 4


@pytest.mark.parametrize("step", STEPS)
def test_a_writer_killed_between_steps_leaves_the_old_state(store, step):
    prepared(store, "one", 1.0)
    store.activate("one", SERIES, DONE)
    store.release("one")
    before = seen(store)
    prepared(store, "two", 2.0, vintage=DAY + datetime.timedelta(1))

    def die(at):
        if at == step:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        store.activate("two", SERIES, DONE, after=die)
    assert seen(store) == before and store.states() == {"one": "ACTIVE", "two": "RUNNING"}
    entry = store.activate("two", SERIES, DONE)  # the same run again
    after = seen(store)
    assert after != before and len(after["pit"]) == 6
    assert store.activate("two", SERIES, DONE) == entry and seen(store) == after


def test_a_conflicting_batch_leaves_nothing(store):
    prepared(store, "one", 1.0)
    store.activate("one", SERIES, DONE)
    store.release("one")
    before = seen(store)
    rows = [("SP500", DAY, DAY, 9.0), ("WALCL", DAY, DAY + datetime.timedelta(2), 9.0)]
    prepared(store, "two", 9.0, pit=pit_rows(store.spark, rows))
    with pytest.raises(CommitError, match="append-only"):
        store.activate("two", SERIES, DONE)
    assert seen(store) == before


def test_equal_rows_are_appended_once(store):
    prepared(store, "one", 1.0)
    store.activate("one", SERIES, DONE)
    store.release("one")
    prepared(store, "two", 1.0)
    store.activate("two", SERIES, DONE)
    assert store.read("pit").count() == 3 and store.read("daily").count() == 2


@pytest.mark.parametrize(
    ("attempts", "issue"),
    [
        ([("SP500", "SUCCEEDED", 1), ("SOFR", "SUCCEEDED", 1)], "NO_ATTEMPT"),
        ([("SP500", "SUCCEEDED", 1), ("SOFR", "FAILED", 1), ("WALCL", "SUCCEEDED", 1)], "FAILED"),
        ([("SP500", "SUCCEEDED", 1), ("SOFR", "SUCCEEDED", 1), ("SOFR", "SUCCEEDED", 1), ("WALCL", "SUCCEEDED", 1)], "REPEATED"),
        ([("SP500", "SUCCEEDED", 0), ("SOFR", "SUCCEEDED", 1), ("WALCL", "SUCCEEDED", 1)], "EMPTY_WITHOUT_HISTORY"),
    ],
)
def test_attempts_are_complete(store, attempts, issue):
    prepared(store, "one", 1.0, attempts=attempts)
    with pytest.raises(CommitError, match=issue):
        store.activate("one", SERIES, DONE)


def test_other_refusals(store):
    prepared(store, "one", 1.0, pit=pit_rows(store.spark, [("SP500", DAY, DAY, 5.0)]))
    with pytest.raises(CommitError, match="latest vintage"):
        store.activate("one", SERIES, DONE)
    with pytest.raises(CommitError, match="future"):
        store.activate("one", SERIES, "2024-01-03 00:00:00")
    with pytest.raises(CommitError, match="clocks"):
        store.stage("one", "pit", pit_rows(store.spark, [("SP500", DAY, DAY, 5.0)]).withColumn("fetched_at", F.lit(None).cast("timestamp")))
    with pytest.raises(CommitError, match="not RUNNING"):
        store.stage("other", "pit", pit_rows(store.spark, []))
    with pytest.raises(CommitError, match="started before"):
        store.start("one")


def test_one_lease_at_a_time(store):
    assert store.acquire("one", 10) and not store.acquire("two", 10)
    store.renew("one", 20)
    store.clock.now += 15
    assert not store.acquire("two", 10)
    store.clock.now += 10
    with pytest.raises(commits.LeaseLost):
        store.renew("one", 10)
    assert store.acquire("two", 10)
    with pytest.raises(commits.LeaseLost):
        store.release("one")
    store.release("two")
    assert store.acquire("one", 10)


def test_a_writer_past_its_lease_cannot_commit(store):
    prepared(store, "one", 1.0)

    def pause(step):
        if step == "counted":
            store.clock.now += 1000
            prepared(store, "two", 2.0)
            store.activate("two", SERIES, DONE)

    with pytest.raises(commits.LeaseLost):
        store.activate("one", SERIES, DONE, after=pause)
    assert store.states() == {"one": "RUNNING", "two": "ACTIVE"} and {r["v"] for r in store.read("observations").collect()} == {2.0}


def test_a_number_is_given_once(store):
    assert store._add(0, {"kind": "lease", "run": "a", "until": 2000}) and not store._add(0, {"kind": "lease", "run": "b", "until": 2000})
    assert [e["run"] for e in store.entries()] == ["a"]
