"""Forward-return labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import asof_first


def forward_pairs(rows: DataFrame, prices: DataFrame, *, days: int, tolerance: int, keys: list[str], on="d", price="close", delay: int = 0, delay_tolerance: int | None = None) -> DataFrame:
    """Adds entry_d, outcome_d and fwd: from the first price at or after ``on`` + delay
    to the first at or after ``days`` later; rows out of tolerance are dropped."""
    start = asof_first(rows.withColumn("__t0", F.date_add(on, delay)), prices, keys=keys, on="__t0", data_on=on, carry=[price], prefix="a_")
    if delay_tolerance is not None:
        start = start.where(F.datediff("a_date", "__t0") <= delay_tolerance)
    start = start.where("a_date is not null").withColumn("__t1", F.date_add("a_date", days))
    end = asof_first(start, prices, keys=keys, on="__t1", data_on=on, carry=[price], prefix="b_")
    end = end.where(F.datediff("b_date", "__t1") <= tolerance)
    fwd = F.try_divide(F.col(f"b_{price}"), F.col(f"a_{price}")) - 1.0
    return end.select(*rows.columns, F.col("a_date").alias("entry_d"), F.col("b_date").alias("outcome_d"), fwd.alias("fwd"))
