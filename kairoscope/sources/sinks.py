"""Writers: staged commits and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import csv_cell
from ..operators.sets import append_new, conflicts


class CommitError(RuntimeError):
    """A staged batch that must not become visible."""


def stage(df: DataFrame, root: str, run_id: str | None = None) -> str:
    """Write a batch under staging/<run>; nothing reads it until it is activated."""
    path = f"{root}/staging/{run_id or uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return path


def activate(spark, root: str, staged: str, key: list[str], value: str, current: str | None) -> str:
    """Append a staged batch to the current version and return the new version's path.

    Conflicting keys stop the commit before anything is written; the caller
    swaps its pointer to the returned path last.
    """
    new = spark.read.parquet(staged)
    old = spark.read.parquet(current) if current else new.limit(0)
    both = old.select(*key, value).unionByName(new.select(*key, value))
    if not conflicts(both, key, value).isEmpty():
        raise CommitError("a key has two values")
    path = f"{root}/version-{uuid.uuid4().hex}"
    append_new(old, new.dropDuplicates(key), key).write.parquet(path)
    return path


def freeze_weeks(old: DataFrame, new: DataFrame, week: str = "week") -> DataFrame:
    """Frozen weeks stay as they are; new rows add weeks that are not there, or replace rows marked legacy."""
    frozen = old.where("not legacy")
    fresh = new.join(frozen.select(week), week, "left_anti")
    kept = old.join(fresh.select(week), week, "left_anti")
    return kept.unionByName(fresh.select(old.columns))


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """One text line for each row, cells escaped and disarmed."""
    return df.select(F.concat_ws(",", *[csv_cell(c) for c in columns]).alias("line"))


def content_hash(df: DataFrame) -> DataFrame:
    """One hash over all rows of a table, whatever their order; for restore checks.

    Rows are hashed where they lie and summed in two halves, so nothing is gathered.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    part = lambda a: F.sum(F.conv(F.substring(row, a, 12), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("n"), part(1).cast("string").alias("h1"), part(13).cast("string").alias("h2"))
