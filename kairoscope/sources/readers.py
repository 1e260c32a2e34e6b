"""Readers of raw payloads. Each takes rows of text and returns typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import finite, loose_date, strict_date, strict_instant


def json_series(payloads: DataFrame, units: dict[str, str] | None = None) -> DataFrame:
    """(series_id, payload) with ``observations: [{date, value}]``; dots, blanks and non-finite values drop out, millions become thousands."""
    kind = "struct<observations:array<struct<date:string,value:string>>>"
    rows = payloads.select("series_id", F.inline(F.from_json("payload", kind)["observations"]))
    v = F.expr("try_cast(value AS DOUBLE)")
    million = F.col("series_id").isin(*[k for k, u in (units or {}).items() if u == "M"]) if units else F.lit(False)
    rows = rows.select("series_id", strict_date("date").alias("d"), F.when(million, v / 1000.0).otherwise(v).alias("v"))
    return rows.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf")) & F.col("d").isNotNull())


def wide_vintages(payloads: DataFrame) -> DataFrame:
    """(series_id, payload): objects with a date and one column <ID>_<YYYYMMDD> for each vintage, melted to rows.

    A column of another name is an error, and so is a date that is none; missing values drop out.
    """
    rows = payloads.select("series_id", F.explode(F.from_json("payload", "struct<observations:array<map<string,string>>>")["observations"]).alias("o"))
    rows = rows.select("series_id", F.col("o")["date"].alias("at"), F.explode(F.map_filter("o", lambda k, v: k != "date")))
    vintage = strict_date(F.regexp_replace(F.regexp_extract("key", r"^\w+_(\d{8})$", 1), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))
    observed, value = strict_date("at"), F.expr("try_cast(value AS DOUBLE)")
    refused = lambda what, c: F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(c, F.lit("null")))).cast("boolean")
    # in the filter, so that rows without a value are judged too
    good = F.when(observed.isNull(), refused("invalid observation date", F.col("at"))).when(vintage.isNull(), refused("unknown vintage column", F.col("key")))
    return rows.where(good.otherwise(value.isNotNull())).select("series_id", observed.alias("obs_date"), vintage.alias("vintage_date"), value.alias("value"))


def release_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows with the release rules whose closed interval holds their vintage; n_rules must be 1."""
    inside = (rows["series_id"] == rules["series_id"]) & rows["vintage_date"].between(rules["valid_from"], rules["valid_to"])
    got = rows.join(rules.withColumnRenamed("series_id", "rule_series").select("rule_series", "valid_from", "valid_to", "release_time"), (F.col("series_id") == F.col("rule_series")) & F.col("vintage_date").between(F.col("valid_from"), F.col("valid_to")), "left") if inside is not None else rows
    w = W.partitionBy("series_id", "obs_date", "vintage_date")
    return got.withColumn("n_rules", F.count("valid_from").over(w)).drop("rule_series")


def csv_series(lines: DataFrame) -> DataFrame:
    """(line): date,value. Adds ordered: each date is after the one before; dots drop out after that check."""
    parts = F.split("line", ",")
    rows = lines.select("n", strict_date(parts[0]).alias("d"), parts[1].alias("raw")).where("d is not null")
    rows = rows.withColumn("ordered", F.coalesce(F.col("d") > F.lag("d").over(W.orderBy("n")), F.lit(True)))
    return rows.where("raw <> '.'").select("d", F.expr("try_cast(raw AS DOUBLE)").alias("v"), "ordered")


def quote_json(payloads: DataFrame) -> DataFrame:
    """(symbol, payload) of a chart payload: price, instant and market state; null where invalid."""
    at = lambda p: F.get_json_object("payload", f"$.chart.result[0].meta.{p}")
    price = F.expr("try_cast(price AS DOUBLE)")
    rows = payloads.select("symbol", at("regularMarketPrice").alias("price"), at("regularMarketTime").alias("t"), at("marketState").alias("state"))
    known = F.when(F.col("state").isin("REGULAR", "PRE", "POST", "CLOSED", "PREPRE", "POSTPOST"), F.col("state")).otherwise("UNKNOWN")
    return rows.select("symbol", price.alias("price"), F.expr("try_cast(t AS BIGINT)").cast("timestamp").alias("at"), known.alias("state"))


#: Fields of a stored decision; a score or VIX that is not a number in the JSON reads as null.
DECISION = (
    "struct<date:string,decision_at:string,recorded_at:string,data_cutoff:string,created_at:string,score:double,verdict:string,netliq_dir:string,vix_eod:double,"
    "qe_qt_regime:string,model_version:string,config_hash:string,code_commit_sha:string,data_run_id:string,factors_json:string,factor_quality_json:string>"
)


def decision_rows(payloads: DataFrame, cutoff: Column) -> DataFrame:
    """``payloads`` (with payload, JSON text) plus row, the typed fields, and issue, the first refusal in order; null where the row is good.

    Clocks are canonical instants with data_cutoff < decision_at <= recorded_at <= created_at,
    all before ``cutoff``.
    """
    rows = payloads.withColumn("row", F.from_json("payload", DECISION)).withColumn("__vix", F.get_json_object("payload", "$.vix_eod"))
    of = lambda c: F.col(f"row.{c}")
    clocks = ("decision_at", "recorded_at", "data_cutoff", "created_at")
    instants = {c: strict_instant(of(c)) for c in clocks}
    finite_ = lambda c: of(c).isNotNull() & ~F.isnan(of(c)) & (F.abs(of(c)) != float("inf"))
    good = lambda c: F.coalesce(c, F.lit(False))
    issue = F.when(F.col("row").isNull() | F.expr("try_parse_json(payload)").isNull(), "INVALID_JSON").when(strict_date(of("date")).isNull(), "date")
    for c in clocks:
        issue = issue.when(instants[c].isNull(), c)
    policy = of("verdict").isin("BULLISH", "NEUTRAL", "BEARISH") & of("netliq_dir").isin("UP", "DOWN", "FLAT") & (F.col("__vix").isNull() | (finite_("vix_eod") & (of("vix_eod") >= 0)))
    object_ = lambda c: F.expr(f"schema_of_variant(try_parse_json(row.{c}))").startswith("OBJECT")
    ordered = (instants["data_cutoff"] < instants["decision_at"]) & (instants["decision_at"] <= instants["recorded_at"]) & (instants["recorded_at"] <= instants["created_at"])
    for c in clocks:
        ordered = ordered & (instants[c] < cutoff)
    for name, ok in {
        "score": finite_("score") & of("score").between(0, 100), "policy": policy, "qe_qt_regime": of("qe_qt_regime").isin("EXPANDING", "CONTRACTING", "FLAT"),
        "model_version": of("model_version").isNotNull() & (of("model_version") != "LEGACY_UNVERSIONED"), "config_hash": of("config_hash").rlike("^[a-f0-9]{64}$"),
        "code_commit_sha": (of("code_commit_sha") == "LOCAL_UNCONFIGURED") | of("code_commit_sha").rlike("^[a-f0-9]{40}$"), "data_run_id": F.length(of("data_run_id")) > 0,
        "clock_order": ordered, "factors_json": object_("factors_json"), "factor_quality_json": object_("factor_quality_json"),
    }.items():
        issue = issue.when(~good(ok), name)
    return rows.withColumn("issue", issue).drop("__vix")


def daily_arrays(payloads: DataFrame) -> DataFrame:
    """(symbol, ts array<long>, close array<double>) zipped to dated finite closes."""
    rows = payloads.select("symbol", F.inline(F.arrays_zip("ts", "close")))
    return rows.where(F.col("close").isNotNull() & (finite("close") == F.col("close"))).select("symbol", F.col("ts").cast("timestamp").cast("date").alias("d"), "close")


def challenge_page(body: Column, content_type: Column | None = None) -> Column:
    """The response is a page for browsers, not data, by its content type or its first 256 characters."""
    kind = F.lower(F.coalesce(content_type, F.lit(""))) if content_type is not None else F.lit("")
    head = F.lower(F.substring(F.regexp_replace(body, r"^\s+", ""), 1, 256))
    page = head.startswith("<!doctype html") | head.startswith("<html") | head.contains("<script") | head.contains("_cf_chl_")
    return kind.contains("text/html") | kind.contains("javascript") | F.coalesce(page, F.lit(False))


def operations_json(payloads: DataFrame, earliest: str = "2021-07-29") -> DataFrame:
    """Overnight operations: accepted amounts in billions, summed by date; earlier dates drop out."""
    kind = "struct<repo:struct<operations:array<struct<operationDate:string,operationType:string,term:string,totalAmtAccepted:double>>>>"
    rows = payloads.select(F.inline(F.from_json("payload", kind)["repo"]["operations"]))
    rows = rows.where("term = 'Overnight'").groupBy(strict_date("operationDate").alias("d")).agg((F.sum("totalAmtAccepted") / 1e9).alias("v"))
    return rows.where(F.col("d") >= F.lit(earliest).cast("date"))


def normalized_dates(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("d", loose_date(column))


def manifest(rows: DataFrame, keys: list[str], on="d", value="v") -> DataFrame:
    """Rows, first and last date and content hash of each series."""
    line = F.concat_ws(",", F.col(on).cast("string"), F.col(value).cast("string"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(on).alias("first"), F.max(on).alias("last"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("hash"),
    )


def provider_choice(candidates: DataFrame, key: list[str]) -> DataFrame:
    """First OK candidate by priority, else the first STALE one, else the first."""
    rank = F.when(F.col("status") == "OK", 0).when(F.col("status") == "STALE", 1).otherwise(2)
    w = W.partitionBy(*key).orderBy(rank, "priority")
    return candidates.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
