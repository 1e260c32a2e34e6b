"""Rolling, expanding and prior-only operators, each over windows of its series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import params as P


def sma(value, n: int, keys: list[str], on="d") -> Column:
    """Mean of the last ``n`` rows with the current one; null with fewer."""
    w = W.partitionBy(*keys).orderBy(on).rowsBetween(1 - n, 0)
    return F.when(F.count(value).over(w) == n, F.avg(value).over(w))


def trailing_days_mean(value, days: int, keys: list[str], on="d") -> Column:
    """Mean over the rows of [t - days + 1, t]."""
    w = W.partitionBy(*keys).orderBy(F.unix_date(on)).rangeBetween(1 - days, 0)
    return F.avg(value).over(w)


def last_n(value, n: int, keys: list[str], on="d") -> Column:
    """The last ``n`` values as an array; null with fewer."""
    w = W.partitionBy(*keys).orderBy(on).rowsBetween(1 - n, 0)
    return F.when(F.count(value).over(w) == n, F.collect_list(value).over(w))


def lag(value, n: int, keys: list[str], on="d") -> Column:
    return F.lag(value, n).over(W.partitionBy(*keys).orderBy(on))


def add_cadence(df: DataFrame, frequency: str, n: int, keys: list[str], on="d", name="cadence_ok") -> DataFrame:
    low, high = P.CADENCE[frequency]
    w = W.partitionBy(*keys).orderBy(on)
    gapped = df.withColumn("__gap", F.datediff(on, F.lag(on).over(w)))
    frame = w.rowsBetween(2 - n, 0)
    bad = F.count(F.when(~F.col("__gap").between(low, high), 1)).over(frame)
    return gapped.withColumn(name, (bad == 0) & (F.count("__gap").over(frame) >= 1)).drop("__gap")


#: Rows of a block of the dominance count.
RANK_BLOCK = 512


def earlier_at_most(df: DataFrame, value: str, keys: list[str], on="d", name="n_at_most") -> DataFrame:
    """Adds the number of earlier rows of the series whose value is at most the row's own; null for a null value.

    Rows are cut into blocks of ``RANK_BLOCK`` twice, by time and by value. Counts of the
    cells (time block, value block) and their two running sums give the rows that are earlier
    and smaller by whole blocks; the rest lies in the row's own value block or time block, of
    bounded size. No row carries its history.
    """
    block = lambda c: F.floor((F.col(c) - 1) / RANK_BLOCK)
    by = lambda *c: W.partitionBy("__key", *c)
    rows = df.withColumn("__key", F.struct(*keys) if keys else F.lit(0)).where(F.col(value).isNotNull())
    rows = rows.withColumn("__t", F.row_number().over(by().orderBy(on))).withColumn("__v", F.row_number().over(by().orderBy(value, "__t")))
    rows = rows.withColumn("__tb", block("__t")).withColumn("__vb", block("__v"))
    cells = rows.groupBy("__key", "__tb", "__vb").agg(F.count(F.lit(1)).alias("__n"))
    span = lambda top: F.explode(F.sequence(F.lit(0).cast("long"), top))
    grid = cells.groupBy("__key").agg(F.max("__tb").alias("__mt"), F.max("__vb").alias("__mv"))
    grid = grid.select("__key", span("__mt").alias("__tb"), "__mv").select("__key", "__tb", span("__mv").alias("__vb"))
    grid = grid.join(cells, ["__key", "__tb", "__vb"], "left").na.fill(0, ["__n"])
    for part, order in (("__vb", "__tb"), ("__tb", "__vb")):
        earlier = by(part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        grid = grid.withColumn("__n", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    mates = F.collect_list(F.struct(F.col("__tb").alias("tb"), F.col("__v").alias("v"))).over(by("__vb"))
    beside = F.size(F.filter(mates, lambda x: (x["tb"] < F.col("__tb")) & (x["v"] < F.col("__v"))))
    past = F.collect_list("__v").over(by("__tb").orderBy("__t").rowsBetween(W.unboundedPreceding, -1))
    inside = F.size(F.filter(past, lambda x: x < F.col("__v")))
    rows = rows.withColumn("__near", beside + inside).join(grid, ["__key", "__tb", "__vb"])
    found = rows.select(*df.columns, (F.col("__near") + F.col("__n")).cast("long").alias(name))
    return found.unionByName(df.where(F.col(value).isNull()).withColumn(name, F.lit(None).cast("long")))


def expanding_share(df: DataFrame, value: str, keys: list[str], on="d", name="share") -> DataFrame:
    """Share of the history up to now, now included, that is at most the current value."""
    rows = earlier_at_most(df, value, keys, on, "__k")
    place = F.row_number().over(W.partitionBy(*keys).orderBy(on))
    return rows.withColumn(name, (F.col("__k") + 1) / place).drop("__k")


def add_prior_mid_rank(df: DataFrame, value: str, keys: list[str], least: int, on="d", name="rank") -> DataFrame:
    """Strictly prior mid-rank in percent: ties count half; null with under ``least`` earlier values."""
    rows = earlier_at_most(df, value, keys, on, "__k")
    order = W.partitionBy(*keys).orderBy(on).rowsBetween(W.unboundedPreceding, -1)
    equal = F.row_number().over(W.partitionBy(*keys, value).orderBy(on)) - 1
    rows = rows.withColumn("__n", F.count(value).over(order)).withColumn("__e", equal)
    rank = (F.col("__k") - F.col("__e") * 0.5) / F.col("__n") * 100.0
    return rows.withColumn(name, F.when((F.col("__n") >= least) & F.col(value).isNotNull() & (F.col("__n") > 0), rank)).drop("__k", "__n", "__e")


def _middle(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    low, high = F.floor((n + 1) / 2).cast("int"), F.floor((n + 2) / 2).cast("int")
    return F.when(n > 0, (F.element_at(s, low) + F.element_at(s, high)) / 2.0)


def prior_mad(value, keys: list[str], rows: int = P.MAD_WEEKS, least: int = P.MAD_MIN, on="d") -> Column:
    """Median absolute deviation of up to ``rows`` earlier values; null under ``least`` or at 0."""
    past = F.collect_list(value).over(W.partitionBy(*keys).orderBy(on).rowsBetween(-rows, -1))
    past = F.filter(past, lambda x: ~F.isnan(x))
    # the centre is bound once, not sorted anew for each value
    mad = F.element_at(F.transform(F.array(_middle(past)), lambda c: _middle(F.transform(past, lambda x: F.abs(x - c)))), 1)
    return F.when((F.size(past) >= least) & (mad > 0), mad)


def average_rank(value, keys: list[str]) -> Column:
    """1-based rank, ties averaged."""
    w = W.partitionBy(*keys).orderBy(value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(W.partitionBy(*keys, value)) - 1) / F.lit(2.0)


def hysteresis(key: Column | str, keys: list[str], on="d", seed: str = "NEUTRAL") -> Column:
    """The last band that was set; ``seed`` before the first. Null keys keep the state."""
    w = W.partitionBy(*keys).orderBy(on).rowsBetween(W.unboundedPreceding, 0)
    return F.coalesce(F.last(key, ignorenulls=True).over(w), F.lit(seed))


def vol_target(ret, keys: list[str], on="d") -> Column:
    """min(1, 10 % / annualised deviation of the 20 returns before this one); 1 without spread, null before."""
    w = W.partitionBy(*keys).orderBy(on).rowsBetween(-P.VOL_SESSIONS, -1)
    sd = F.stddev_pop(ret).over(w)
    scaled = F.least(F.lit(1.0), F.try_divide(F.lit(P.VOL_TARGET), sd * F.sqrt(F.lit(float(P.SESSIONS)))))
    return F.when(F.count(ret).over(w) < P.VOL_SESSIONS, None).when(sd == 0, 1.0).otherwise(scaled)


def ma_control(close, keys: list[str], on="d") -> Column:
    """1 if the previous close is above the mean of the 200 closes before this one, else 0."""
    order = W.partitionBy(*keys).orderBy(on)
    w = order.rowsBetween(-P.MA_SESSIONS, -1)
    above = F.lag(close).over(order) > F.avg(close).over(w)
    return F.when((F.count(close).over(w) == P.MA_SESSIONS) & above, 1.0).otherwise(0.0)


def revisions(pit: DataFrame, key: list[str], vintage="vintage_date", value="value") -> DataFrame:
    """Rows that revise an earlier vintage, with the previous value and the change."""
    w = W.partitionBy(*key).orderBy(vintage)
    return pit.withColumn("previous", F.lag(value).over(w)).where("previous is not null").withColumn("delta", F.col(value) - F.col("previous"))


def drawdown(nav: DataFrame, keys: list[str], on="d", value="nav", start: float | None = None) -> DataFrame:
    """Adds peak, drawdown (0 or less) and below: sessions in a row under the peak."""
    w = W.partitionBy(*keys).orderBy(on)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    peak = F.max(value).over(upto)
    if start is not None:
        peak = F.greatest(peak, F.lit(float(start)))
    out = nav.withColumn("peak", peak)
    out = out.withColumn("drawdown", F.col(value) / F.col("peak") - 1.0)
    out = out.withColumn("__spell", F.sum((F.col(value) >= F.col("peak")).cast("int")).over(upto))
    spell = W.partitionBy(*keys, "__spell").orderBy(on).rowsBetween(W.unboundedPreceding, 0)
    return out.withColumn("below", F.sum((F.col(value) < F.col("peak")).cast("long")).over(spell)).drop("__spell")


def carry_forward(df: DataFrame, value: str, keys: list[str], on="d", default: float = 0.0) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(on).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(default)))
