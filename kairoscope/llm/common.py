"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A folder of our own is used only where the session names none and all of it
    runs on one machine, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file:///tmp/kairoscope-shared"
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_dir(spark)}/kairoscope-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage like a checkpoint, keeps the columnar encoding, and
    survives the loss of any executor.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df`` and never more, chosen by a seeded hash.

    A counted share of the hashes is let through by the tasks, so that what
    reaches the driver has the same size whatever the number of partitions.
    """
    n = df.count()
    if n > rows:
        df = df.where(key.bitwiseAND(F.lit((1 << 53) - 1)) < F.lit(int(rows / n * (1 << 53))))
    return df.orderBy(key).limit(rows)


#: A group of more than this part of all rows is heavy, so there are never more heavy groups than this.
HEAVY = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` joined with ``groups`` (one row for each value of ``keys``, never null; ``size``: its rows).

    Groups of over 1 / HEAVY of the rows counted in ``groups`` are at most HEAVY
    and are broadcast, so that no task gets all rows of one of them; all others
    meet by one exchange. ``groups`` should be a written table.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    heavy = groups.where(F.col(size) > total / HEAVY).where(F.col(size) > HEAVY)
    if heavy.isEmpty():
        return rows.join(groups.hint("merge"), keys)
    light = groups.where(~((F.col(size) > total / HEAVY) & (F.col(size) > HEAVY)))
    rest = rows.join(F.broadcast(heavy.select(keys)), keys, "left_anti")
    return rows.join(F.broadcast(heavy), keys).unionByName(rest.join(light.hint("merge"), keys))
