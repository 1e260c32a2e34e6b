"""Seeded keys that spread rows evenly, rows that are equal included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rows of one key that stay under it; more of them are numbered.
ALIKE = 64
#: Numbered rows that one row stands for while they move.
CHUNK = 4096


def row_hash(df: DataFrame) -> Column:
    return F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c in df.columns])


def keyed_rows(df: DataFrame, seed: int, columns: list[str], *, alike: int = ALIKE) -> DataFrame:
    """``row`` (a struct of all columns of ``df``) and ``key`` (long), a hash of ``columns``.

    Where more than ``alike`` rows have one key, those equal in all columns are
    counted, and each is dealt out again with a number of its own in its key. So
    the keys are a function of the rows alone, and no key has many rows.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    key = F.xxhash64(F.lit(seed), *columns)
    keyed = df.select(row, key.alias("key"))
    hot = materialize(df.select(key.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > alike).select("key"), "hot-rows")
    if hot.isEmpty():
        return keyed
    counted = keyed.join(hot, "key", "left_semi").groupBy("key", "row").agg(F.count(F.lit(1)).alias("n"))
    chunks = counted.select("row", "key", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))).alias("first"))
    chunks = chunks.repartition("key", "first")  # the rows of a chunk are made where it went
    numbered = chunks.select("row", "key", F.explode(F.sequence("first", F.least(F.col("first") + CHUNK, "n") - 1)).alias("number"))
    number = F.xxhash64(F.lit(seed), "key", F.xxhash64("row"), "number")
    return keyed.join(hot, "key", "left_anti").select("row", "key").unionByName(numbered.select("row", number.alias("key")))
