"""A paged source of vintages as a Spark data source.

A history is asked for in windows of vintage dates, and each window in pages.
Every (series, window) is an input partition of its own, so Spark spreads the
requests, and a task that is run again asks for its own window only. Requests
are retried within bounds, against a budget of attempts for each partition.

The transport here reads pages that were recorded as files; a client of a
service differs in ``get`` alone. A status that is not 2xx after all attempts
fails the task.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Days of a window, rows of a page, attempts of a request and their cap, delays in seconds.
WINDOW_DAYS, PAGE_ROWS, ATTEMPTS, MOST_ATTEMPTS, BASE_DELAY, MAX_DELAY = 2000, 100_000, 3, 5, 0.1, 2.0

Response = tuple[int, str]


class BudgetSpent(RuntimeError):
    """No attempt is left."""


@dataclass
class Budget:
    limit: int
    used: int = 0

    def take(self) -> None:
        if self.used >= self.limit:
            raise BudgetSpent(f"all {self.limit} attempts are spent")
        self.used += 1


def retryable(status: int) -> bool:
    return status == 429 or status >= 500


def delay(failed: int, draw: float, *, base: float = BASE_DELAY, most: float = MAX_DELAY) -> float:
    """Full jitter under an exponential bound."""
    return min(most, base * 2 ** (failed - 1)) * min(1.0, max(0.0, draw))


def fetch(
    get: Callable[[str], Response], url: str, *, method: str = "GET", attempts: int = ATTEMPTS, budget: Budget | None = None, sleep: Callable[[float], None] = time.sleep, draw: Callable[[], float] = random.random
) -> Response:
    """The response to a request that may be repeated: transport errors, 429 and 5xx are tried again.

    The last response is returned whatever its status; the last error is raised.
    """
    if method not in ("GET", "HEAD"):
        raise ValueError("only GET and HEAD may be tried again")
    attempts = min(max(attempts, 1), MOST_ATTEMPTS)
    for attempt in range(1, attempts + 1):
        if budget is not None:
            budget.take()
        try:
            response = get(url)
            if not retryable(response[0]) or attempt == attempts:
                return response
        except OSError:
            if attempt == attempts:
                raise
        sleep(delay(attempt, draw()))
    raise AssertionError("unreachable")


def windows(first: date, last: date, days: int) -> list[tuple[date, date]]:
    """Closed ranges of at most ``days`` days that cover first to last."""
    out = []
    while first <= last:
        end = min(last, first + timedelta(days - 1))
        out.append((first, end))
        first = end + timedelta(1)
    return out


def recorded(path: str, faults: int = 0) -> Callable[[str], Response]:
    """A transport over recorded pages; with ``faults`` the first attempts at each page fail with 503."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    store, root = fs.FileSystem.from_uri(path)
    tried: dict[str, int] = {}

    def get(url: str) -> Response:
        tried[url] = tried.get(url, 0) + 1
        if tried[url] <= faults:
            return 503, ""
        found = [f for f in store.get_file_info(fs.FileSelector(f"{root}/{url}", allow_not_found=True)) if f.base_name.startswith("part-")]
        if not found:
            return 404, ""
        with store.open_input_stream(found[0].path) as stream:
            return 200, stream.read().decode()

    return get


def page_url(series_id: str, window: tuple[date, date], page: int) -> str:
    return f"series_id={series_id}/window={window[0]}_{window[1]}/page={page}"


class Range(InputPartition):
    def __init__(self, series_id: str, first: date, last: date):
        self.series_id, self.first, self.last = series_id, first, last


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.series = json.loads(options["series"])
        self.first, self.last = date.fromisoformat(options["first"]), date.fromisoformat(options["last"])
        self.days, self.attempts = int(options.get("window_days", WINDOW_DAYS)), int(options.get("attempts", ATTEMPTS))
        self.budget, self.faults = int(options.get("budget", 10_000)), int(options.get("faults", 0))

    def partitions(self) -> list[InputPartition]:
        return [Range(s, a, b) for s in self.series for a, b in windows(self.first, self.last, self.days)]

    def read(self, partition: Range) -> Iterator[tuple]:
        get, budget = recorded(self.path, self.faults), Budget(self.budget)
        offset, page, total = 0, 0, 1
        while offset < total:
            url = page_url(partition.series_id, (partition.first, partition.last), page)
            status, body = fetch(get, url, attempts=self.attempts, budget=budget, sleep=lambda s: None if self.faults else time.sleep(s))
            if not 200 <= status < 300:
                raise OSError(f"{url}: status {status}")
            answer = json.loads(body)
            rows, total = answer["observations"], answer["count"]
            if answer["offset"] != offset or (not rows and offset < total):
                raise OSError(f"{url}: page at {answer['offset']} of {total}, wanted {offset}")
            for row in rows:
                value = None if row["value"] == "." else float(row["value"])
                if value is not None:
                    yield partition.series_id, date.fromisoformat(row["date"]), date.fromisoformat(row["realtime_start"]), value
            offset, page = offset + len(rows), page + 1


class PagedVintages(DataSource):
    """Options: path, series (JSON list), first, last, window_days, attempts, budget, faults."""

    @classmethod
    def name(cls) -> str:
        return "paged_vintages"

    def schema(self) -> str:
        return "series_id string, obs_date date, vintage_date date, value double"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))


def record_pages(pit: DataFrame, path: str, *, first: date, last: date, window_days: int = WINDOW_DAYS, page_rows: int = PAGE_ROWS) -> None:
    """Writes vintages (series_id, obs_date, vintage_date, value) as the pages that a service would answer with, empty windows too."""
    spark = pit.sparkSession
    cut = windows(first, last, window_days)
    named = spark.createDataFrame([(i, f"{a}_{b}") for i, (a, b) in enumerate(cut)], "w int, window string")
    rows = pit.withColumn("w", F.floor(F.datediff("vintage_date", F.lit(str(first)).cast("date")) / window_days).cast("int"))
    place = W.partitionBy("series_id", "w").orderBy("vintage_date", "obs_date")
    rows = rows.withColumn("i", F.row_number().over(place) - 1).withColumn("count", F.count(F.lit(1)).over(W.partitionBy("series_id", "w")))
    told = F.struct(F.col("obs_date").cast("string").alias("date"), F.col("vintage_date").cast("string").alias("realtime_start"), F.coalesce(F.col("value").cast("string"), F.lit(".")).alias("value"))
    pages = rows.groupBy("series_id", "w", F.floor(F.col("i") / page_rows).alias("page"), "count").agg(F.array_sort(F.collect_list(F.struct("i", told.alias("o")))).alias("a"))
    asked = pit.select("series_id").distinct().crossJoin(F.broadcast(named))
    pages = asked.join(pages, ["series_id", "w"], "left")
    page = F.coalesce("page", F.lit(0))
    answer = F.struct(F.coalesce("count", F.lit(0)).alias("count"), (page * page_rows).alias("offset"), F.coalesce(F.transform("a", lambda x: x["o"]), F.array()).alias("observations"))
    out = pages.select("series_id", "window", page.cast("int").alias("page"), F.to_json(answer).alias("value"))
    out.repartition("series_id", "window", "page").write.partitionBy("series_id", "window", "page").text(path)
