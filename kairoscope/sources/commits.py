"""Activation of a staged run as one commit, under a lease.

A store is a folder that all writers share. Runs stage their rows as Parquet;
nothing reads these. What is visible is told by a log of small entries: leases,
starts of runs and commits, each made once under the next free number. A commit
names the parts that it adds, so readers see all of a run or nothing of it, and
a writer that dies between two steps leaves parts that no entry names.

As leases and commits share one order, a commit under number n holds only if the
lease in force before n is the writer's own and has not expired: a writer that
was paused past its lease loses the number to the next one, and finds so.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .sinks import CommitError

PIT_KEY = ["series_id", "obs_date", "vintage_date"]
#: Series whose current rows must equal their latest vintage, and those that make daily revisions.
CHECKED = ("SP500", "VIXCLS", "SOFR")
DAILY = {"SP500": "SPX", "VIXCLS": "VIX", "SOFR": "SOFR"}
TABLES = ("pit", "observations", "daily")


class LeaseLost(CommitError):
    """The writer holds no lease in force."""


class Store:
    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock

    # ------------------------------------------------------------ the log

    def _fs(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def entries(self) -> list[dict]:
        """All entries in order. They are one for each lease, start and commit, not for each row."""
        fs, at = self._fs(f"{self.root}/log")
        if not fs.exists(at):
            return []
        lines = self.spark.read.text(f"{self.root}/log/*.json").collect()
        return sorted((json.loads(r["value"]) for r in lines), key=lambda e: e["number"])

    def _add(self, number: int, entry: dict) -> bool:
        """Makes entry ``number`` unless it is there; the file appears whole or not at all."""
        text = json.dumps(entry | {"number": number})
        fs, final = self._fs(f"{self.root}/log/{number:012d}.json")
        _, draft = self._fs(f"{self.root}/drafts/{uuid.uuid4().hex}")
        fs.mkdirs(final.getParent())
        out = fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.getScheme() == "file":  # a local rename would replace the entry, a link does not
            try:
                os.link(draft.toUri().getPath(), final.toUri().getPath())
            except FileExistsError:
                return False
            return True
        return bool(fs.rename(draft, final))

    def _append(self, entry: dict, allowed: Callable[[list[dict]], str | None]) -> dict:
        """Adds an entry if ``allowed`` has no objection to the log before it."""
        while True:
            log = self.entries()
            refusal = allowed(log)
            if refusal:
                raise LeaseLost(refusal)
            if self._add(len(log), entry):
                return entry | {"number": len(log)}

    # ------------------------------------------------------------ leases

    def _holder(self, log: list[dict]) -> dict | None:
        last = next((e for e in reversed(log) if e["kind"] in ("lease", "release")), None)
        return last if last and last["kind"] == "lease" and last["until"] > self.clock() else None

    def _mine(self, run: str) -> Callable[[list[dict]], str | None]:
        def allowed(log: list[dict]) -> str | None:
            holder = self._holder(log)
            return None if holder and holder["run"] == run else f"run {run} holds no lease"

        return allowed

    def acquire(self, run: str, seconds: float) -> bool:
        """Takes the lease if no other is in force."""
        try:
            self._append({"kind": "lease", "run": run, "until": self.clock() + seconds}, lambda log: "held" if self._holder(log) else None)
        except LeaseLost:
            return False
        return True

    def renew(self, run: str, seconds: float) -> None:
        self._append({"kind": "lease", "run": run, "until": self.clock() + seconds}, self._mine(run))

    def release(self, run: str) -> None:
        self._append({"kind": "release", "run": run}, self._mine(run))

    # ------------------------------------------------------------ runs

    def states(self) -> dict[str, str]:
        """RUNNING, ACTIVE (the last commit) or SUPERSEDED for each run."""
        out = {}
        for e in self.entries():
            if e["kind"] == "start":
                out[e["run"]] = "RUNNING"
            elif e["kind"] == "commit":
                out = {r: "SUPERSEDED" if s == "ACTIVE" else s for r, s in out.items()} | {e["run"]: "ACTIVE"}
        return out

    def start(self, run: str) -> None:
        self._append({"kind": "start", "run": run}, lambda log: f"run {run} was started before" if any(e["kind"] == "start" and e["run"] == run for e in log) else self._mine(run)(log))

    def stage(self, run: str, table: str, rows: DataFrame) -> None:
        """Rows of a run that is RUNNING; staging a table again replaces it."""
        if self.states().get(run) != "RUNNING":
            raise CommitError(f"run {run} is not RUNNING")
        if table == "pit":
            bad = rows.where(F.coalesce((F.col("released_at") > F.col("tradable_at")) | F.col("fetched_at").isNull() | F.col("released_at").isNull(), F.lit(True)))
            if not bad.isEmpty():
                raise CommitError("a vintage has invalid clocks")
        rows.write.mode("overwrite").parquet(f"{self.root}/staging/{run}/{table}")

    # ------------------------------------------------------------ reading

    def _parts(self, table: str, log: list[dict] | None = None) -> list[str]:
        return [e["parts"][table] for e in (self.entries() if log is None else log) if e["kind"] == "commit" and table in e["parts"]]

    def read(self, table: str) -> DataFrame | None:
        """What is visible: all vintages, current values, or all daily revisions. None before the first commit."""
        parts = self._parts(table)
        rows = self.spark.read.parquet(*parts) if parts else None
        return _current(rows) if rows is not None and table == "observations" else rows

    # ------------------------------------------------------------ activation

    def activate(self, run: str, configured: list[str], completed_at: str, *, after: Callable[[str], None] = lambda step: None) -> dict:
        """Makes the staged rows of ``run`` visible, all at once. A run that was committed before stays as it is.

        ``after`` is called behind each step. Whatever fails, and wherever the
        writer dies, what was visible before stays visible.
        """
        log = self.entries()
        done = next((e for e in log if e["kind"] == "commit" and e["run"] == run), None)
        if done:
            return done
        if self.states().get(run) != "RUNNING":
            raise CommitError(f"run {run} is not RUNNING")
        refusal = self._mine(run)(log)
        if refusal:
            raise LeaseLost(refusal)
        staged = {t: self.spark.read.parquet(f"{self.root}/staging/{run}/{t}") for t in ("pit", "observations", "attempts")}
        old_pit, old_rows, old_daily = self.read("pit"), self._all("observations", log), self._all("daily", log)
        sequence = 1 + sum(e["kind"] == "commit" for e in log)
        home = f"{self.root}/parts/{run}-{uuid.uuid4().hex}"

        def write(table: str, rows: DataFrame) -> DataFrame:
            rows.write.parquet(f"{home}/{table}")
            after(table)
            return self.spark.read.parquet(f"{home}/{table}")

        _refuse(attempt_issues(staged["attempts"], configured, old_rows), "attempt")
        _refuse(future_rows(staged["pit"], completed_at), "row of the future")
        after("attempts")
        if old_pit is not None:
            _refuse(checksum_conflicts(staged["pit"], old_pit), "conflict with an append-only vintage")
        _refuse(staged["pit"].groupBy(*PIT_KEY).agg(F.count_distinct("checksum").alias("n")).where("n > 1"), "conflict inside the run")
        after("conflicts")
        fresh = staged["pit"].dropDuplicates(PIT_KEY).withColumn("run_id", F.lit(run))
        fresh = write("pit", append_only(old_pit, fresh))
        pit = fresh if old_pit is None else old_pit.unionByName(fresh)
        added = write("observations", staged["observations"].dropDuplicates(["series_id", "d"]).withColumn("sequence", F.lit(sequence)))
        current = _current(added if old_rows is None else old_rows.unionByName(added))
        latest = latest_vintages(pit)
        _refuse(mismatches(current, latest), "current value that is not its latest vintage")
        after("latest")
        moved = daily_revisions(current.join(staged["observations"].select("series_id", "d"), ["series_id", "d"], "left_semi"), latest, old_daily)
        write("daily", moved.withColumn("activation_run_id", F.lit(run)).withColumn("sequence", F.lit(sequence)))
        entry = {
            "kind": "commit", "run": run, "completed_at": completed_at, "parts": {t: f"{home}/{t}" for t in TABLES}, "sequence": sequence,
            "row_count": staged["observations"].count(), "series_count": staged["attempts"].where("status = 'SUCCEEDED'").count(),
        }
        after("counted")
        out = self._append(entry, self._mine(run))
        after("committed")
        return out

    def _all(self, table: str, log: list[dict]) -> DataFrame | None:
        parts = self._parts(table, log)
        return self.spark.read.parquet(*parts) if parts else None


# ---------------------------------------------------------------- guards, each a frame that must be empty


def _refuse(rows: DataFrame, what: str) -> None:
    first = rows.first()
    if first is not None:
        raise CommitError(f"{what}: {first.asDict()}")


def attempt_issues(attempts: DataFrame, configured: list[str], active: DataFrame | None) -> DataFrame:
    """series_id and issue: each configured series has exactly one attempt, succeeded, and rows unless it has some already."""
    spark = attempts.sparkSession
    wanted = spark.createDataFrame([(s,) for s in configured], "series_id string")
    seen = attempts.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("status") == "SUCCEEDED").alias("ok"), F.sum("row_count").alias("rows"))
    held = active.select("series_id").distinct().withColumn("held", F.lit(True)) if active is not None else spark.createDataFrame([], "series_id string, held boolean")
    issue = (
        F.when(F.col("n").isNull(), "NO_ATTEMPT").when(F.col("n") > 1, "REPEATED").when(~F.coalesce("ok", F.lit(False)), "FAILED")
        .when((F.col("rows") == 0) & F.col("held").isNull(), "EMPTY_WITHOUT_HISTORY")
    )
    return wanted.join(seen, "series_id", "left").join(held, "series_id", "left").select("series_id", issue.alias("issue")).where("issue is not null")


def future_rows(pit: DataFrame, completed_at: str) -> DataFrame:
    """Vintages, observations and fetches dated after the run was completed."""
    end = F.lit(completed_at).cast("timestamp")
    late = (F.col("fetched_at") > end) | (F.col("obs_date") > end.cast("date")) | (F.col("vintage_date") > end.cast("date"))
    return pit.where(late).select(*PIT_KEY)


def checksum_conflicts(staged: DataFrame, held: DataFrame) -> DataFrame:
    both = staged.select(*PIT_KEY, "checksum").join(held.select(*PIT_KEY, F.col("checksum").alias("held")), PIT_KEY)
    return both.where("checksum <> held")


def append_only(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """The rows of ``new`` whose key is not there yet."""
    return new if old is None else new.join(old.select(*PIT_KEY), PIT_KEY, "left_anti").select(new.columns)


def _current(rows: DataFrame) -> DataFrame:
    """The last commit's value of each series and date."""
    return rows.groupBy("series_id", "d").agg(F.max_by("v", "sequence").alias("v"))


def latest_vintages(pit: DataFrame) -> DataFrame:
    """The row of the highest vintage of each observation."""
    order = W.partitionBy("series_id", "obs_date").orderBy(F.col("vintage_date").desc())
    return pit.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def mismatches(current: DataFrame, latest: DataFrame) -> DataFrame:
    """Current values of the checked series that have vintages and differ from the latest one."""
    checked = current.where(F.col("series_id").isin(*CHECKED))
    both = checked.join(latest.select("series_id", F.col("obs_date").alias("d"), "value"), ["series_id", "d"])
    return both.where(~F.col("v").eqNullSafe(F.col("value"))).select("series_id", "d", "v", "value")


def daily_revisions(current: DataFrame, latest: DataFrame, old: DataFrame | None) -> DataFrame:
    """symbol, d, value, source, fetched_at, provenance of daily rows that are new or differ from the last revision."""
    names = reduce(lambda c, p: c.when(F.col("series_id") == p[0], p[1]), DAILY.items(), F.when(F.lit(False), F.lit("")))
    origin = latest.select("series_id", F.col("obs_date").alias("d"), "source", "fetched_at", F.lit("PIT_RAW").alias("provenance"), F.col("value").alias("v"))
    rows = current.where(F.col("series_id").isin(*DAILY)).join(origin, ["series_id", "d", "v"], "left")
    rows = rows.select(
        names.alias("symbol"), "d", F.col("v").alias("value"), F.coalesce("source", F.concat(F.lit("FEED:"), "series_id")).alias("source"), "fetched_at",
        F.coalesce("provenance", F.lit("LEGACY_NO_PIT")).alias("provenance"),
    )
    if old is None:
        return rows
    same = ["symbol", "d", "value", "source", "provenance"]
    order = W.partitionBy("symbol", "d").orderBy(F.col("sequence").desc())
    last = old.withColumn("__r", F.row_number().over(order)).where("__r = 1").select(*same)
    return rows.join(last, same, "left_anti")
