"""Gates: the first reason why a set of inputs is refused, by comparing its clocks, ids and statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import params as P
from .asof import asof_last, fresh


def first_reason(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The reason of the first row of each key that has one; keys without any have no row."""
    return rows.where(F.col("reason").isNotNull()).groupBy(*keys).agg(F.min_by("reason", F.struct(*order)).alias("reason"))


def provenance_issues(cases: DataFrame, signals: DataFrame, daily: DataFrame, keys: list[str], methodology: str) -> DataFrame:
    """Keys and the first reason why their inputs are not formal.

    ``cases`` has keys and cutoff; ``signals`` idx, recorded_at, data_run_id, target_exposure
    and methodology; ``daily`` kind (their order), d, fetched_at, data_run_id,
    activation_run_id, activated_at and status. Signals come first, in order, then daily rows.
    """
    none = lambda *names: F.greatest(*[F.col(n).isNull() for n in names], F.lit(False))
    cutoffs = F.broadcast(cases.select(*keys, "cutoff"))
    signal = (
        F.when(none("recorded_at", "data_run_id"), "missing official signal provenance")
        .when(none("target_exposure") | ~F.col("methodology").eqNullSafe(F.lit(methodology)), "missing explicit formal portfolio target")
        .when(F.col("recorded_at") >= F.col("cutoff"), "signal not visible strictly before as-of cutoff")
    )
    row = (
        F.when(none("fetched_at", "data_run_id", "activation_run_id"), "missing daily input provenance").when(none("activated_at"), "missing daily input activation time")
        .when(F.col("activated_at") >= F.col("cutoff"), "daily input not visible strictly before as-of cutoff").when(F.col("status") == "SYNTHETIC_BACKFILL", "synthetic backfill is not formal input")
        .when(F.col("status") == "LEGACY_NO_PIT", "legacy input without PIT provenance").when(~F.col("status").eqNullSafe(F.lit("PIT_RAW")), "missing daily input provenance status")
    )
    start = F.lit("1970-01-01").cast("date")
    place = lambda part, first, second: [F.lit(part).alias("part"), first.cast("long").alias("first"), second.alias("second")]
    rows = cases.select(*keys, *place(0, F.lit(0), start), F.when(none("cutoff"), "missing as-of cutoff provenance").alias("reason"))
    rows = rows.unionByName(signals.join(cutoffs, keys).select(*keys, *place(1, F.col("idx"), start), signal.alias("reason")))
    rows = rows.unionByName(daily.join(cutoffs, keys).select(*keys, *place(2, F.col("kind"), F.col("d")), row.alias("reason")))
    return first_reason(rows, keys, ["part", "first", "second"])


# Anchors of the raw and smooth net-liquidity history, and the days and gaps that they may have.
ANCHOR, TREASURY, AVERAGE, REPO = "WALCL", "WDTGAL", "WTREGEN", "RRPONTSYD"
AVAILABLE_DAYS, MAX_ANCHORS, MIN_ANCHORS, WEEK_DAYS, REPO_ROWS, REPO_SPAN = 7, 170, 66, 6, 5, 16


def _age_fits(series_id: str, found: Column, at: Column) -> Column:
    _, _, calendar, business, _, _, fallback = P.SERIES[series_id]
    return fresh(F.lit(0), found, at, calendar_days=calendar, business_days=business, fallback=F.lit(fallback))["status"] == "FRESH"


def raw_smooth_gate(decisions: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the weekly history of each decision (keys, d) can be used: n_anchors, and a reason or null.

    What an anchor needs (its treasury row of the same day, a fresh weekly average, five
    regular repo rows) is settled once for each anchor by as-of joins. A decision then reads
    trailing windows at its last available anchor, so no decision gathers its history.
    """
    of = lambda s: series.where(F.col("series_id") == s).select(*keys, "d", "v")
    order = W.partitionBy(*keys).orderBy("d")
    gap_in = lambda c, rows, low, high: (F.min(c).over(rows) >= low) & (F.max(c).over(rows) <= high)

    repo = of(REPO).withColumn("gap", F.datediff("d", F.lag("d").over(order)))
    five = order.rowsBetween(1 - REPO_ROWS, 0)
    regular = (F.count(F.lit(1)).over(five) == REPO_ROWS) & gap_in("gap", order.rowsBetween(2 - REPO_ROWS, 0), *P.CADENCE["DAILY"])
    repo = repo.select(*keys, "d", regular.alias("regular"), F.lag("d", REPO_ROWS - 1).over(order).alias("fifth"))

    rows = of(ANCHOR).select(*keys, "d")
    rows = rows.join(of(TREASURY).select(*keys, "d").distinct().withColumn("exact", F.lit(True)), [*keys, "d"], "left")
    rows = asof_last(rows, of(AVERAGE), keys=keys, carry=["v"], prefix="t_")
    rows = asof_last(rows, repo, keys=keys, carry=["regular", "fifth"], prefix="r_")
    at = F.col("d")
    average = _age_fits(AVERAGE, F.col("t_date"), at) & (F.datediff(at, "t_date") <= WEEK_DAYS)
    rows = rows.select(
        *keys, "d", F.coalesce("exact", F.lit(False)).alias("exact"), F.coalesce(average, F.lit(False)).alias("average"),
        F.coalesce(_age_fits(REPO, F.col("r_date"), at) & F.col("r_regular"), F.lit(False)).alias("repo"), F.col("r_fifth").alias("fifth"),
        F.datediff("d", F.lag("d").over(order)).alias("gap"), F.datediff("t_date", F.lag("t_date").over(order)).alias("t_gap"), (F.weekday("d") == 2).alias("wednesday"),
    )
    held, gaps = order.rowsBetween(1 - MAX_ANCHORS, 0), order.rowsBetween(2 - MAX_ANCHORS, 0)
    every = lambda c: F.min(c).over(held)
    span = F.datediff(F.min("d").over(held), F.first("fifth").over(held)) <= REPO_SPAN
    rows = rows.select(
        *keys, "d", F.count(F.lit(1)).over(held).alias("n"), gap_in("gap", gaps, *P.CADENCE["WEEKLY"]).alias("cadence"), every("wednesday").alias("wednesday"), every("exact").alias("exact"),
        every("average").alias("average"), (every("repo") & F.coalesce(span, F.lit(False))).alias("repo"), gap_in("t_gap", gaps, *P.CADENCE["WEEKLY"]).alias("t_cadence"),
    )
    wrong = series.where(F.col("series_id").isin(ANCHOR, TREASURY, AVERAGE, REPO)).groupBy(*keys, "series_id", "d").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(~F.isnan("v") & (F.abs("v") != float("inf")), F.lit(False))).alias("finite")
    )
    wrong = wrong.where("n > 1 or not finite").select(*keys, "d").distinct()
    got = asof_last(decisions, wrong.withColumn("bad", F.lit(True)), keys=keys, carry=["bad"], prefix="w_")
    got = got.withColumn("__at", F.date_sub("d", AVAILABLE_DAYS))
    got = asof_last(got, rows, keys=keys, on="__at", data_on="d", carry=["n", "cadence", "wednesday", "exact", "average", "repo", "t_cadence"], prefix="a_")
    bad = lambda c: ~F.coalesce(F.col(f"a_{c}"), F.lit(False))
    n = F.coalesce("a_n", F.lit(0))
    reason = (
        F.when(F.col("w_bad"), "INVALID_SERIES").when(n < MIN_ANCHORS, "TOO_FEW_ANCHORS").when(bad("cadence"), "ANCHOR_CADENCE").when(bad("wednesday"), "ANCHOR_WEEKDAY")
        .when(~_age_fits(ANCHOR, F.col("a_date"), F.col("d")), "STALE_ANCHOR").when(bad("exact"), "TREASURY_DATE_MISSING").when(bad("average"), "TREASURY_AVERAGE_STALE")
        .when(bad("repo"), "REPO_WINDOW").when(bad("t_cadence"), "TREASURY_AVERAGE_CADENCE")
    )
    return got.select(*decisions.columns, n.cast("long").alias("n_anchors"), reason.alias("reason"))


def ledger_issues(entries: DataFrame, keys: list[str]) -> DataFrame:
    """``entries`` (keys, place, id, supersedes, registered_at and counts of declared trials) with the first issue of each, or null.

    An id stands once, and an entry may supersede an earlier one only. As every reference
    goes backwards, a ledger without issues has no cycle.
    """
    order = W.partitionBy(*keys, "id").orderBy("place")
    rows = entries.withColumn("__n", F.row_number().over(order))
    first = rows.where("__n = 1").select(*keys, F.col("id").alias("supersedes"), F.col("place").alias("__of"))
    rows = rows.join(first, [*keys, "supersedes"], "left")
    refers = F.col("supersedes").isNotNull()
    counts = [F.coalesce(F.col(c) >= 1, F.lit(False)) for c in ("directions", "windows", "parameters")]
    issue = (
        F.when(F.coalesce(F.length("id"), F.lit(0)) == 0, "MISSING_ID").when(F.col("__n") > 1, "REPEATED_ID").when(~(counts[0] & counts[1] & counts[2]), "INVALID_COUNT")
        .when(refers & F.col("__of").isNull(), "UNKNOWN_REFERENCE").when(refers & (F.col("__of") == F.col("place")), "REFERS_TO_ITSELF")
        .when(refers & (F.col("__of") > F.col("place")), "FORWARD_REFERENCE")
    )
    return rows.select(*entries.columns, issue.alias("issue"))


def ledger_digest(entries: DataFrame, keys: list[str]) -> DataFrame:
    """A digest of each ledger over its entries and their places; rows are hashed where they lie and summed, so none are gathered."""
    row = F.sha2(F.to_json(F.struct("place", "id", "supersedes", "directions", "windows", "parameters")), 256)
    part = lambda a: F.sum(F.conv(F.substring(row, a, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("|", part(1), part(13), part(25)), 256).alias("digest"))
