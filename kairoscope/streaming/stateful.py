"""State that is carried through a stream: verdicts with exposures, and a rate limiter.

Each key has a few values of state. The rows of a micro-batch are put in order
within their key; a row that is not after the last one seen of its key is late
and gives nothing, so a row that comes twice counts once. The batch twins in
this module give the same rows from a whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import params as P
from ..functions import scores as C
from ..operators import windows as N
from ..operators.asof import asof_last
from ..operators.sets import chronological_set

#: The state store that keyed state needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
JUDGED = "user_id long, event_id long, ts timestamp, verdict string, old_exposure double, new_exposure double"
LIMITED = "user_id long, event_id long, ts timestamp, window_start timestamp, attempt long, allowed boolean"
STEPS = {"BULLISH": P.EXPOSURES["full"], "NEUTRAL": P.EXPOSURES["middle"], "BEARISH": P.EXPOSURES["low"]}


def _in_order(rows: Iterator[pd.DataFrame], last: tuple | None) -> pd.DataFrame:
    """The rows of a key in this batch, in order, without those that are not after ``last``."""
    found = pd.concat(list(rows)).drop_duplicates("event_id").sort_values(["ts", "event_id"])
    if last is not None:
        at, number = pd.Timestamp(last[0]), last[1]
        found = found[(found.ts > at) | ((found.ts == at) & (found.event_id > number))]
    return found


class Judge(StatefulProcessor):
    """Bands with hysteresis, and the exposure that each verdict leaves and takes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts timestamp, event_id long, verdict string, exposure double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.last.get() if self.last.exists() else None
        found = _in_order(rows, state[:2] if state else None)
        if found.empty:
            return
        band = pd.Series(None, found.index, object)
        band[found.value > P.BULL_ABOVE] = "BULLISH"
        band[found.value < P.BEAR_BELOW] = "BEARISH"
        verdict = band.ffill().fillna(state[2] if state else "NEUTRAL")
        new = verdict.map(STEPS)
        old = new.shift(1).fillna(state[3] if state else 0.0)
        self.last.update((found.ts.iloc[-1].to_pydatetime(), int(found.event_id.iloc[-1]), verdict.iloc[-1], float(new.iloc[-1])))
        yield pd.DataFrame({"user_id": key[0], "event_id": found.event_id, "ts": found.ts, "verdict": verdict, "old_exposure": old, "new_exposure": new})

    def close(self) -> None:
        pass


class Limiter(StatefulProcessor):
    """At most ``limit`` attempts in a window that begins with the first attempt after the last window's end."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.span = limit, pd.Timedelta(seconds=seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts timestamp, event_id long, start timestamp, attempts long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.last.get() if self.last.exists() else None
        found = _in_order(rows, state[:2] if state else None)
        if found.empty:
            return
        start, attempts = (pd.Timestamp(state[2]), state[3]) if state else (None, 0)
        out = []
        for at in found.ts:
            if start is None or at >= start + self.span:
                start, attempts = at, 0
            attempts += 1
            out.append((start, attempts, attempts <= self.limit))
        self.last.update((found.ts.iloc[-1].to_pydatetime(), int(found.event_id.iloc[-1]), start.to_pydatetime(), attempts))
        starts, numbers, allowed = zip(*out, strict=True)
        yield pd.DataFrame({"user_id": key[0], "event_id": found.event_id.values, "ts": found.ts.values, "window_start": starts, "attempt": numbers, "allowed": allowed})

    def close(self) -> None:
        pass


def _run(events: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    return events.groupBy("user_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")


def judged_stream(events: DataFrame) -> DataFrame:
    return _run(events.select("user_id", "event_id", "ts", "value"), Judge(), JUDGED)


def limited_stream(events: DataFrame, *, limit: int, seconds: int) -> DataFrame:
    return _run(events.select("user_id", "event_id", "ts"), Limiter(limit, seconds), LIMITED)


def use_keyed_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


# ---------------------------------------------------------------- the same from a whole table


def judged(events: DataFrame) -> DataFrame:
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.withColumn("__at", F.struct("ts", "event_id")).withColumn("verdict", N.hysteresis(C.band("value"), ["user_id"], "__at"))
    new = F.coalesce(*[F.when(F.col("verdict") == v, x) for v, x in STEPS.items()])
    rows = rows.withColumn("new_exposure", new)
    return rows.select("user_id", "event_id", "ts", "verdict", F.lag("new_exposure", 1, 0.0).over(order).alias("old_exposure"), "new_exposure")


def limited(events: DataFrame, *, limit: int, seconds: int) -> DataFrame:
    rows = events.select("user_id", "event_id", "ts").withColumn("end", F.col("ts") + F.make_dt_interval(secs=F.lit(seconds)))
    starts = chronological_set(rows, ["user_id"], "ts", "end").select("user_id", F.col("ts").alias("start"))
    got = asof_last(rows.drop("end"), starts, keys=["user_id"], on="ts", data_on="start", carry=["start"], prefix="w_")
    number = F.row_number().over(W.partitionBy("user_id", "w_start").orderBy("ts", "event_id")).cast("long")
    return got.select("user_id", "event_id", "ts", F.col("w_start").alias("window_start"), number.alias("attempt"), (number <= limit).alias("allowed"))
