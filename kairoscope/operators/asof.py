"""Temporal joins.

An as-of join is one union, one exchange on the series key and one sort: data
and probe rows are put in one order, and each probe takes the last (or next)
data row by a window. No probe is compared with more than its neighbours, so
the cost does not depend on how far a value is carried. Null keys and null
dates match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _asof(probe: DataFrame, data: DataFrame, keys: list[str], on: str, data_on: str, carry: list[str], prefix: str, forward: bool, strict: bool) -> DataFrame:
    """Probe rows plus <prefix>date and <prefix><c> of the matched data row."""
    names = [c for c in probe.columns if c not in keys]
    p = probe.select(
        *keys, F.col(on).alias("__at"), F.lit(True).alias("__probe"), F.struct(*names).alias("__row"),
        F.lit(None).cast(data.select(F.struct(F.col(data_on).alias("date"), *carry)).schema[0].dataType).alias("__got"),
    )
    d = data.where(F.col(data_on).isNotNull()).select(
        *keys, F.col(data_on).alias("__at"), F.lit(False).alias("__probe"),
        F.lit(None).cast(p.schema["__row"].dataType).alias("__row"), F.struct(F.col(data_on).alias("date"), *carry).alias("__got"),
    )
    # a probe stands after the data of its instant if they count, before them if not
    data_first = forward == strict
    order = W.partitionBy(*keys).orderBy("__at", F.when(F.col("__probe"), int(data_first)).otherwise(int(not data_first)))
    if forward:
        got = F.first("__got", ignorenulls=True).over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    else:
        got = F.last("__got", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    got = F.when(known & F.col("__at").isNotNull(), got)
    out = p.unionByName(d).withColumn("__match", got).where("__probe")
    return out.select(*keys, "__row.*", F.col("__match.date").alias(f"{prefix}date"), *[F.col(f"__match.{c}").alias(f"{prefix}{c}") for c in carry])


def asof_last(probe, data, *, keys: list[str], on: str = "d", data_on: str = "d", carry: list[str], prefix: str = "asof_", strict: bool = False) -> DataFrame:
    """Last data row at or before (``strict``: before) the probe's date."""
    return _asof(probe, data, keys, on, data_on, carry, prefix, False, strict)


def asof_first(probe, data, *, keys: list[str], on: str = "d", data_on: str = "d", carry: list[str], prefix: str = "next_", strict: bool = False) -> DataFrame:
    """First data row at or after (``strict``: after) the probe's date."""
    return _asof(probe, data, keys, on, data_on, carry, prefix, True, strict)


def fresh(value: Column, found: Column, at: Column, *, calendar_days, business_days=None, fallback=None) -> Column:
    """struct(value, date, age, status): the value is null if it is older than either bound,
    or not of the day itself where no fallback is allowed."""
    from ..functions.scalars import business_days as weekdays

    age = F.datediff(at, found)
    stale = age > calendar_days
    if business_days is not None:
        stale = stale | (weekdays(found, at) > business_days)
    if fallback is not None:
        stale = stale | ((fallback == "NONE") & (found != at))
    status = F.when(found.isNull(), "MISSING").when(stale, "STALE").otherwise("FRESH")
    return F.struct(F.when(status == "FRESH", value).alias("value"), found.alias("date"), age.cast("long").alias("age"), status.alias("status"))


def asof_tolerance(probe, data, *, keys: list[str], on: str = "d", carry: str = "v", days: int = 10) -> DataFrame:
    """Backward match of at most ``days`` age, or else the last row within ``days`` after."""
    back = asof_last(probe, data, keys=keys, on=on, carry=[carry], prefix="b_")
    both = asof_last(back.withColumn("__late", F.date_add(on, days)), data, keys=keys, on="__late", carry=[carry], prefix="f_")
    near = F.datediff(on, "b_date") <= days
    ahead = F.col("f_date") >= F.col(on)
    pick = lambda c: F.when(near, F.col(f"b_{c}")).when(ahead, F.col(f"f_{c}"))
    return both.select(*probe.columns, pick("date").alias("asof_date"), pick(carry).alias(f"asof_{carry}"))


def lookback_change(series: DataFrame, days: int, *, keys: list[str], on: str = "d", value: str = "v") -> DataFrame:
    """Adds prior (as of ``days`` earlier), prior_date and change."""
    got = asof_last(series.withColumn("__then", F.date_sub(on, days)), series, keys=keys, on="__then", data_on=on, carry=[value], prefix="p_")
    return got.select(*series.columns, F.col("p_date").alias("prior_date"), F.col(f"p_{value}").alias("prior"), (F.col(value) - F.col(f"p_{value}")).alias("change"))


def align(anchors: DataFrame, others: dict[str, DataFrame], *, on: str = "d", value: str = "v") -> DataFrame:
    """Anchor rows with the as-of value of each other series (all of one key); rows lacking any are dropped.

    All series travel in one union and one sort.
    """
    rows = anchors.select(F.col(on).alias("__at"), F.lit(1).alias("__p"), F.struct(*anchors.columns).alias("__row"), *[F.lit(None).cast("double").alias(n) for n in others])
    for name, s in others.items():
        part = s.select(F.col(on).alias("__at"), F.lit(0).alias("__p"), F.col(value).alias(name))
        rows = rows.unionByName(part, allowMissingColumns=True)
    order = W.partitionBy().orderBy("__at", "__p").rowsBetween(W.unboundedPreceding, W.currentRow)
    held = rows.select("__p", "__row", *[F.last(n, ignorenulls=True).over(order).alias(n) for n in others])
    return held.where("__p = 1").select("__row.*", *others).na.drop(subset=list(others))


def latest_visible(rows: DataFrame, key: list[str], order: list[Column], visible: Column) -> DataFrame:
    """The newest row of each key among those that ``visible`` lets through before ranking."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return rows.where(visible).withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def validity_intervals(pit: DataFrame, *, key: list[str], vintage: str = "vintage_date", released: str = "released_at") -> DataFrame:
    """Rows that raise their key's highest vintage, each valid in [released, next raise)."""
    w = W.partitionBy(*key).orderBy(released, vintage)
    high = F.max(vintage).over(w.rowsBetween(W.unboundedPreceding, -1))
    kept = pit.withColumn("__high", high).where(F.col("__high").isNull() | (F.col(vintage) >= F.col("__high"))).drop("__high")
    return kept.withColumn("valid_to", F.lead(released).over(w))


#: Buckets of keys that the intervals of a year are dealt to.
KEY_BUCKETS = 32


def bitemporal_frames(pit: DataFrame, events: DataFrame, *, key: list[str]) -> DataFrame:
    """For each event (event_id, model_date, decision_at) the row of each key that is visible:
    released by the decision, observed by the model date, of the highest vintage.

    The range join meets the intervals of one year and one bucket of keys only; an
    interval is listed in each year that it spans, an event in each bucket of keys.
    """
    far = F.lit("9999-01-01").cast("timestamp")
    bucket = lambda t: F.year(t)
    spans = validity_intervals(pit, key=key).withColumn("__end", F.coalesce("valid_to", far))
    last = events.agg(F.coalesce(F.max(F.year("decision_at")), F.lit(1900)).alias("__last"))
    spans = spans.crossJoin(F.broadcast(last)).where(F.year("released_at") <= F.col("__last"))
    spans = spans.withColumn("__b", F.explode(F.sequence(bucket("released_at"), F.least(bucket("__end"), F.greatest("__last", F.year("released_at"))))))
    spans = spans.withColumn("__k", F.pmod(F.xxhash64(*key), F.lit(KEY_BUCKETS)).cast("int"))
    e = events.withColumn("__b", bucket("decision_at")).withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(KEY_BUCKETS - 1))))
    joined = e.join(spans, ["__b", "__k"]).where((F.col("released_at") <= F.col("decision_at")) & (F.col("decision_at") < F.col("__end")))
    return joined.where(F.col("obs_date") <= F.col("model_date")).drop("__b", "__k", "__end", "__last")


def interval_join(points: DataFrame, ranges: DataFrame, *, on: str, start: str, end: str) -> DataFrame:
    """Points in [start, end) of a table of ranges; a null end is open. Adds n_matches.

    Points meet the ranges of their own year only; a range is listed in each year of the points that it spans.
    """
    years = points.agg(F.min(F.year(on)).alias("__y0"), F.max(F.year(on)).alias("__y1"))  # one row
    spans = ranges.crossJoin(F.broadcast(years)).withColumn("__from", F.greatest(F.year(start), "__y0"))
    spans = spans.withColumn("__to", F.least(F.coalesce(F.year(end), F.col("__y1")), F.col("__y1"))).where("__from <= __to")
    spans = spans.withColumn("__y", F.explode(F.sequence("__from", "__to"))).drop("__from", "__to", "__y0", "__y1")
    inside = (F.col("__p") == F.col("__y")) & (F.col(start) <= F.col(on)) & (F.col(end).isNull() | (F.col(end) > F.col(on)))
    joined = points.withColumn("__p", F.year(on)).join(spans, inside, "left").drop("__p", "__y")
    return joined.withColumn("n_matches", F.count(F.col(start)).over(W.partitionBy(*points.columns)))


def splice(base: DataFrame, market: DataFrame, *, on: str = "d", value: str = "v") -> DataFrame:
    """Base series, extended past its end by the market's moves since its value as of that end."""
    end = base.agg(F.max(on).alias("__end"), F.max_by(value, on).alias("__level"))
    anchor = market.crossJoin(F.broadcast(end)).where(F.col(on) <= F.col("__end")).agg(F.max_by(value, on).alias("__anchor"))
    later = market.crossJoin(F.broadcast(end)).crossJoin(F.broadcast(anchor)).where((F.col(on) > F.col("__end")) & (F.col("__anchor") != 0))
    return base.select(on, value).unionByName(later.select(on, (F.col("__level") * F.col(value) / F.col("__anchor")).alias(value)))
