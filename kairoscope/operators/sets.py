"""Independent samples, purging, upserts and other set operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import params as P


def _greedy(df: DataFrame, keys: list[str], order: list[str], start: str, end: str) -> DataFrame:
    """Rows in order, each kept if its start is at or after the end of the last one kept.

    The fold runs over the sorted intervals of one group; only the interval and
    the ordinal travel in the array.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("__i", F.row_number().over(w))
    folded = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__i", F.col(start).alias("s"), F.col(end).alias("e")))).alias("a"))
    kept = F.aggregate(
        "a",
        F.struct(F.lit(None).cast(df.schema[end].dataType).alias("end"), F.array().cast("array<int>").alias("kept")),
        lambda s, x: F.when(
            s["end"].isNull() | (x["s"] >= s["end"]), F.struct(x["e"].alias("end"), F.concat(s["kept"], F.array(x["__i"])).alias("kept"))
        ).otherwise(s),
        lambda s: s["kept"],
    )
    chosen = folded.select(*keys, F.explode(kept).alias("__i"))
    return rows.join(chosen, [*keys, "__i"]).drop("__i")


def earliest_exit_set(pairs: DataFrame, keys: list[str], start="d", end="outcome_d") -> DataFrame:
    """Largest set of label intervals that do not overlap: by outcome, then start."""
    return _greedy(pairs, keys, [end, start], start, end)


def chronological_set(pairs: DataFrame, keys: list[str], start="d", end="outcome_d") -> DataFrame:
    """Greedy by start."""
    return _greedy(pairs, keys, [start, end], start, end)


def calendar_step_set(rows: DataFrame, keys: list[str], days: int, on="d") -> DataFrame:
    """Rows at least ``days`` after the last one taken."""
    return _greedy(rows.withColumn("__until", F.date_add(on, days)), keys, [on], on, "__until").drop("__until")


def purge(pairs: DataFrame, test_from: Column, outcome="outcome_d", embargo_days: int = P.EMBARGO_DAYS) -> DataFrame:
    """Adds split: PURGED (outcome at or after the test), EMBARGOED (in the embargo before it), KEPT."""
    o = F.col(outcome)
    split = F.when(o >= test_from, "PURGED").when(o >= F.date_sub(test_from, embargo_days), "EMBARGOED").otherwise("KEPT")
    return pairs.withColumn("split", split)


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last write wins: one row of each key, of the newest of ``order``; new rows beat old ones."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = W.partitionBy(*key).orderBy(F.col("__new").desc(), *[F.col(o).desc() for o in order])
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__new")


def append_new(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """First write wins: rows of ``new`` whose key is not there yet."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti").select(old.columns))


def changed_revisions(old: DataFrame, new: DataFrame, key: list[str], order: str, compare: list[str]) -> DataFrame:
    """Rows of ``new`` that differ from the latest old revision of their key."""
    w = W.partitionBy(*key).orderBy(F.col(order).desc())
    last = old.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*key, F.struct(*compare).alias("__last"))
    return new.join(last, key, "left").where(~F.struct(*compare).eqNullSafe(F.col("__last"))).select(new.columns)


def conflicts(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys that carry more than one value; must be empty before an append."""
    return rows.groupBy(*key).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with the side's name; empty if both are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def per_week(rows: DataFrame, keys: list[str], on="d") -> DataFrame:
    """The last row of each week that starts on Monday."""
    week = F.date_trunc("week", on).cast("date")
    w = W.partitionBy(*keys, "week").orderBy(F.col(on).desc())
    return rows.withColumn("week", week).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
