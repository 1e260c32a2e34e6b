"""Queries: gates, provenance, display rules, payload rows and counts of stored tables.

Rules whose inputs the driver's tables lack (provenance ids, statuses, clocks as
text) get them from keys, so that every branch is met.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from ..functions.texts import DIRECTION_LABEL, EASING_GAP, IMPULSE_LABEL, TIGHTENING_GAP, VERDICT_LABEL, reason
from ..operators import asof as A
from ..operators import windows as N
from .harness import h_factor, h_obs, h_pit, h_price, h_signal, h_week, query, r6, table

PASSING_SCORE = 50
LEGACY = "LEGACY_UNVERSIONED"


def _case(column: str, labels: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + " END"


def cycle(values: list, by: str | Column = "idx") -> Column:
    """One of ``values`` in turn by a number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col(by) if isinstance(by, str) else by, F.lit(len(values))) + 1).cast("int"))


@query("reason_text", "h_signal", f"""
    WITH x AS (SELECT idx, verdict, ['FLAT','EXPANDING','CONTRACTING'][idx % 3 + 1] AS i, ['FLAT','UP','DOWN','UP'][idx % 4 + 1] AS n FROM h_signal)
    SELECT idx, 'Fed ' || {_case("i", IMPULSE_LABEL)} || '、净流动性' || {_case("n", DIRECTION_LABEL)} || ' → 环境' || {_case("verdict", VERDICT_LABEL)}
        || CASE WHEN i = 'CONTRACTING' AND n = 'UP' THEN '{EASING_GAP}' WHEN i = 'EXPANDING' AND n = 'DOWN' THEN '{TIGHTENING_GAP}' ELSE '' END AS reason FROM x""")
def reason_text(spark, sf):
    x = h_signal(spark, sf).select("idx", "verdict", cycle(["FLAT", "EXPANDING", "CONTRACTING"]).alias("i"), cycle(["FLAT", "UP", "DOWN", "UP"]).alias("n"))
    return x.select("idx", reason("i", "n", "verdict").alias("reason"))


_PIVOT = """p AS (SELECT w, max(f) FILTER (factor = '1-URGENT') AS a, max(f) FILTER (factor = '2-HIGH') AS b, max(f) FILTER (factor = '3-MEDIUM' AND day(w) > 5) AS c,
    max(f) FILTER (factor = '4-NOT SPECIFIED') AS d, max(f) FILTER (factor = '5-LOW' AND day(w) > 9) AS e FROM h_factor GROUP BY w)"""


def _pivot(spark, sf) -> DataFrame:
    f, of = h_factor(spark, sf), lambda k, more=F.lit(True): F.max(F.when((F.col("factor") == k) & more, F.col("f")))
    day = F.dayofmonth("w")
    return f.groupBy("w").agg(
        of("1-URGENT").alias("a"), of("2-HIGH").alias("b"), of("3-MEDIUM", day > 5).alias("c"), of("4-NOT SPECIFIED").alias("d"), of("5-LOW", day > 9).alias("e")
    )


@query("pillar_flags", "h_factor", f"""
    WITH {_PIVOT} SELECT w, coalesce(a >= {PASSING_SCORE}, false) AND coalesce(b >= {PASSING_SCORE}, false) AND coalesce(c >= {PASSING_SCORE}, false) AS p0,
        coalesce(d >= {PASSING_SCORE}, false) OR coalesce(e >= {PASSING_SCORE}, false) AS p1, coalesce(c >= {PASSING_SCORE}, false) AS p2, coalesce(e >= {PASSING_SCORE}, false) AS p3 FROM p""")
def pillar_flags(spark, sf):
    """A missing score fails its pillar."""
    ok = lambda c: F.coalesce(F.col(c) >= PASSING_SCORE, F.lit(False))
    return _pivot(spark, sf).select("w", (ok("a") & ok("b") & ok("c")).alias("p0"), (ok("d") | ok("e")).alias("p1"), ok("c").alias("p2"), ok("e").alias("p3"))


@query("liquidity_decomposition", "h_week", """
    WITH p AS (SELECT w, max(v) FILTER (series_id = '1-URGENT') AS walcl, max(v) FILTER (series_id = '2-HIGH') AS tga, max(v) FILTER (series_id = '3-MEDIUM') AS rrp FROM h_week GROUP BY w HAVING count(*) = 5),
    q AS (SELECT *, walcl - tga - rrp AS net FROM p)
    SELECT w, round(net, 6) AS net, round(walcl - lag(walcl) OVER y, 6) AS d_walcl, round(tga - lag(tga) OVER y, 6) AS d_tga, round(rrp - lag(rrp) OVER y, 6) AS d_rrp,
        round(net - lag(net) OVER y, 6) AS d_net FROM q WINDOW y AS (ORDER BY w)""")
def liquidity_decomposition(spark, sf):
    of = lambda k: F.max(F.when(F.col("series_id") == k, F.col("v")))
    p = h_week(spark, sf).groupBy("w").agg(of("1-URGENT").alias("walcl"), of("2-HIGH").alias("tga"), of("3-MEDIUM").alias("rrp"), F.count(F.lit(1)).alias("n")).where("n = 5")
    p = p.withColumn("net", F.col("walcl") - F.col("tga") - F.col("rrp"))
    y = W.orderBy("w")  # one row for each week
    return p.select("w", r6("net", "net"), *[r6(F.col(c) - F.lag(c).over(y), f"d_{c}") for c in ("walcl", "tga", "rrp", "net")])


@query("percentile_score", "h_week", """
    WITH x AS (SELECT a.series_id, a.w, count(*) FILTER (b.v <= a.v) / count(*) AS p FROM h_week a JOIN h_week b ON a.series_id = b.series_id AND b.w <= a.w GROUP BY 1, 2)
    SELECT series_id, w, round(CASE WHEN series_id < '3' THEN 1 - p ELSE p END * 100, 6)::DOUBLE AS score FROM x""")
def percentile_score(spark, sf):
    rows = N.expanding_share(h_week(spark, sf), "v", ["series_id"], "w")
    return rows.select("series_id", "w", r6(F.when(F.col("series_id") < "3", 1 - F.col("share")).otherwise(F.col("share")) * 100, "score"))


@query("display_staleness", "h_signal", """
    WITH x AS (SELECT idx, idx % 12 AS days, round(idx % 10 / 9 * 9)::BIGINT AS covered, idx % 9 AS hours, idx % 7 = 0 AS failed FROM h_signal)
    SELECT idx, days, days > 8 AS stale, CAST(covered AS VARCHAR) || '/9' AS coverage, hours > 6 OR failed AS ingest_flag FROM x""")
def display_staleness(spark, sf):
    x = h_signal(spark, sf).select("idx", "d", F.date_add("d", (F.col("idx") % 12).cast("int")).alias("today"))
    days = F.datediff("today", "d").cast("long")
    covered = F.round(F.col("idx") % 10 / 9 * 9).cast("long").cast("string")
    return x.select("idx", days.alias("days"), (days > 8).alias("stale"), F.concat(covered, F.lit("/9")).alias("coverage"), ((F.col("idx") % 9 > 6) | (F.col("idx") % 7 == 0)).alias("ingest_flag"))


@query("display_tags", "h_signal h_vix", """
    SELECT s.d, s.score / 1000 <= 0.05 AS spread_good, coalesce(v.v, 99) < 25 AS vix_good, ['FLAT','UP','DOWN'][idx % 3 + 1] = 'UP' AS direction_good FROM h_signal s LEFT JOIN h_vix v ON v.d = s.d""")
def display_tags(spark, sf):
    from .harness import h_vix

    rows = h_signal(spark, sf).join(h_vix(spark, sf), "d", "left")
    return rows.select("d", (F.col("score") / 1000 <= 0.05).alias("spread_good"), (F.coalesce("v", F.lit(99)) < 25).alias("vix_good"), (cycle(["FLAT", "UP", "DOWN"]) == "UP").alias("direction_good"))


@query("robust_conclusion", "h_factor", """
    WITH q AS (SELECT factor, quarter(w) AS regime, avg(f) - 50 AS ic FROM h_factor GROUP BY 1, 2),
    x AS (SELECT factor, avg(f) - 50 AS point, avg(f) - 50 - 1.96 * stddev_samp(f) / sqrt(count(*)) AS lo FROM h_factor GROUP BY 1)
    SELECT x.factor, CASE WHEN lo > 0 THEN 'ROBUST' WHEN point > 0 THEN 'WEAK' ELSE 'NOT_SIGNIFICANT' END AS edge, (SELECT arg_max(regime, ic) FROM q WHERE q.factor = x.factor) AS best_regime FROM x""")
def robust_conclusion(spark, sf):
    f = h_factor(spark, sf)
    best = f.groupBy("factor", F.quarter("w").cast("long").alias("regime")).agg((F.avg("f") - 50).alias("ic")).groupBy("factor").agg(F.max_by("regime", "ic").alias("best_regime"))
    x = f.groupBy("factor").agg((F.avg("f") - 50).alias("point"), (F.avg("f") - 50 - 1.96 * F.stddev_samp("f") / F.sqrt(F.count(F.lit(1)))).alias("lo"))
    return x.join(best, "factor").select("factor", F.when(F.col("lo") > 0, "ROBUST").when(F.col("point") > 0, "WEAK").otherwise("NOT_SIGNIFICANT").alias("edge"), "best_regime")


# ---------------------------------------------------------------- gates

_ISO = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{3})?Z$"


def canonical_instant(text: str | Column) -> Column:
    """An instant in canonical text form that exists."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text.rlike(_ISO) & F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull(), F.lit(False))


@query("stored_clock_issues", "", f"""
    WITH x AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '2024-02-31T00:00:00Z' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' END AS f,
        CASE WHEN event_id % 5 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000Z' END AS r,
        CASE WHEN event_id % 13 <> 0 THEN strftime(ts + to_hours(CAST(event_id % 3 - 1 AS INTEGER)), '%Y-%m-%dT%H:%M:%S') || 'Z' END AS t FROM events),
    y AS (SELECT *, regexp_full_match(f, '{_ISO}') AND try_strptime(substr(f, 1, 19), '%Y-%m-%dT%H:%M:%S') IS NOT NULL AS f_ok, regexp_full_match(r, '{_ISO}') AS r_ok, coalesce(regexp_full_match(t, '{_ISO}'), false) AS t_ok FROM x),
    z AS (SELECT event_id, CASE WHEN NOT f_ok THEN 'fetched' WHEN NOT r_ok THEN 'released' WHEN NOT t_ok THEN 'tradable' WHEN substr(t, 1, 19) < substr(r, 1, 19) THEN 'order' END AS issue FROM y)
    SELECT * FROM z WHERE issue IS NOT NULL""")
def stored_clock_issues(spark, sf):
    iso = lambda ts, form="yyyy-MM-dd'T'HH:mm:ss": F.date_format(ts, form)
    k, z = F.col("event_id"), F.lit("Z")
    x = table(spark, sf, "events").select(
        "event_id", F.when(k % 11 == 0, "2024-02-31T00:00:00Z").otherwise(F.concat(iso("ts"), z)).alias("f"),
        F.when(k % 5 == 0, iso("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.concat(iso("ts"), F.lit(".000Z"))).alias("r"),
        F.when(k % 13 != 0, F.concat(iso(F.expr("ts + make_dt_interval(0, cast(event_id % 3 - 1 as int))")), z)).alias("t"),
    )
    order = F.substring("t", 1, 19) < F.substring("r", 1, 19)
    issue = F.when(~canonical_instant("f"), "fetched").when(~canonical_instant("r"), "released").when(~canonical_instant("t"), "tradable").when(order, "order")
    return x.select("event_id", issue.alias("issue")).where("issue is not null")


@query("override_clock_issues", "", """
    SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS vintage, l_suppkey AS source, CAST(count(*) AS BIGINT) AS n, bool_or(l_linenumber < 2) AS early FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1 OR bool_or(l_linenumber < 2)""")
def override_clock_issues(spark, sf):
    """Overrides that repeat a (series, vintage, source) or may be traded before their release."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("series_id"), F.to_date("l_shipdate").alias("vintage"), F.col("l_suppkey").alias("source"), F.to_date("l_shipdate").alias("released"),
        F.expr("date_add(to_date(l_shipdate), l_linenumber - 2)").alias("tradable"),
    )
    found = rows.groupBy("series_id", "vintage", "source").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("tradable") < F.col("released")).alias("early"))
    return found.where("n > 1 or early")


@query("policy_field_issues", "h_signal", """
    WITH x AS (SELECT idx, CASE WHEN idx % 13 = 0 THEN 'nan'::DOUBLE WHEN idx % 17 <> 0 THEN score END AS score, CASE WHEN idx % 19 = 0 THEN 'UNKNOWN' ELSE verdict END AS verdict,
        ['UP','DOWN','FLAT','SIDE'][idx % 4 + 1] AS direction, CASE idx % 5 WHEN 0 THEN -1.0 WHEN 1 THEN 18.5 WHEN 2 THEN 'inf'::DOUBLE END AS vix FROM h_signal)
    SELECT idx, CASE WHEN score IS NULL OR NOT isfinite(score) OR verdict NOT IN ('BULLISH','NEUTRAL','BEARISH') OR direction NOT IN ('UP','DOWN','FLAT') OR (vix IS NOT NULL AND (NOT isfinite(vix) OR vix < 0)) THEN 'invalid official portfolio field' END AS issue FROM x""")
def policy_field_issues(spark, sf):
    k = F.col("idx")
    x = h_signal(spark, sf).select(
        "idx", F.when(k % 13 == 0, F.lit(float("nan"))).when(k % 17 != 0, F.col("score")).alias("score"), F.when(k % 19 == 0, "UNKNOWN").otherwise(F.col("verdict")).alias("verdict"),
        cycle(["UP", "DOWN", "FLAT", "SIDE"]).alias("direction"), F.when(k % 5 == 0, -1.0).when(k % 5 == 1, 18.5).when(k % 5 == 2, F.lit(float("inf"))).alias("vix"),
    )
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    ok = finite("score") & F.col("verdict").isin(*VERDICT_LABEL) & F.col("direction").isin(*DIRECTION_LABEL) & (F.col("vix").isNull() | (finite("vix") & (F.col("vix") >= 0)))
    return x.select("idx", F.when(~ok, "invalid official portfolio field").alias("issue"))


_IDS = f"""ids AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '{LEGACY}' WHEN c_custkey % 23 <> 0 THEN 'm-1' END AS model,
    CASE WHEN c_custkey % 5 = 0 THEN '{LEGACY}' WHEN c_custkey % 7 = 0 THEN 'abc' ELSE sha256(c_name) END AS config,
    CASE WHEN c_custkey % 10 = 0 THEN '{LEGACY}' WHEN c_custkey % 3 = 0 THEN 'LOCAL_UNCONFIGURED' ELSE substr(sha256(c_mktsegment), 1, 40) END AS code,
    CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 10 <> 0 THEN 'run-' || c_custkey END AS run FROM customer)"""


def _ids(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        "c_custkey", F.when(k % 5 == 0, LEGACY).when(k % 23 != 0, "m-1").alias("model"),
        F.when(k % 5 == 0, LEGACY).when(k % 7 == 0, "abc").otherwise(F.sha2("c_name", 256)).alias("config"),
        F.when(k % 10 == 0, LEGACY).when(k % 3 == 0, "LOCAL_UNCONFIGURED").otherwise(F.substring(F.sha2("c_mktsegment", 256), 1, 40)).alias("code"),
        F.when(k % 11 == 0, "").when(k % 10 != 0, F.concat(F.lit("run-"), k.cast("string"))).alias("run"),
    )


def provenance_class() -> Column:
    """GOVERNED, LEGACY or INVALID by the forms of model, config, code and run ids."""
    legacy = reduce(Column.__and__, [F.col(c) == LEGACY for c in ("model", "config", "code")])
    governed = F.col("model").isNotNull() & F.col("config").rlike("^[a-f0-9]{64}$") & ((F.col("code") == "LOCAL_UNCONFIGURED") | F.col("code").rlike("^[a-f0-9]{40}$")) & (F.length("run") > 0)
    return F.when(legacy, "LEGACY").when(governed, "GOVERNED").otherwise("INVALID")


@query("provenance_class", "", f"""
    WITH {_IDS} SELECT c_custkey, CASE WHEN model = '{LEGACY}' AND config = '{LEGACY}' AND code = '{LEGACY}' THEN 'LEGACY'
        WHEN model IS NOT NULL AND regexp_full_match(config, '[a-f0-9]{{64}}') AND (code = 'LOCAL_UNCONFIGURED' OR regexp_full_match(code, '[a-f0-9]{{40}}')) AND length(run) > 0 THEN 'GOVERNED' ELSE 'INVALID' END AS provenance FROM ids""")
def provenance_classes(spark, sf):
    return _ids(spark, sf).select("c_custkey", provenance_class().alias("provenance"))


@query("governed_identity_issue", "", f"""
    WITH {_IDS}, g AS (SELECT i.*, c_nationkey FROM ids i JOIN customer USING (c_custkey) WHERE model IS NOT NULL AND regexp_full_match(config, '[a-f0-9]{{64}}'))
    SELECT c_nationkey, CASE WHEN bool_or(model <> 'm-1') THEN 'MODEL_COHORT_MISMATCH' WHEN bool_or(NOT (code = 'LOCAL_UNCONFIGURED' OR regexp_full_match(code, '[a-f0-9]{{40}}')) OR coalesce(run, '') = '') THEN 'INCOMPLETE_GOVERNED_PROVENANCE' END AS issue FROM g GROUP BY 1""")
def governed_identity_issue(spark, sf):
    g = _ids(spark, sf).join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey").where(F.col("model").isNotNull() & F.col("config").rlike("^[a-f0-9]{64}$"))
    odd = ~((F.col("code") == "LOCAL_UNCONFIGURED") | F.col("code").rlike("^[a-f0-9]{40}$")) | (F.coalesce("run", F.lit("")) == "")
    return g.groupBy("c_nationkey").agg(F.when(F.bool_or(F.col("model") != "m-1"), "MODEL_COHORT_MISMATCH").when(F.bool_or(odd), "INCOMPLETE_GOVERNED_PROVENANCE").alias("issue"))


@query("version_schema", "", f"""
    WITH {_IDS} SELECT c_custkey, CASE WHEN model = '{LEGACY}' AND config = '{LEGACY}' AND code = '{LEGACY}' THEN 'LEGACY' WHEN model = '{LEGACY}' OR config = '{LEGACY}' OR code = '{LEGACY}' THEN 'MIXED'
        WHEN model IS NULL OR coalesce(run, '') = '' THEN 'MISSING' ELSE 'VERSIONED' END AS schema_class FROM ids""")
def version_schema(spark, sf):
    one = [F.coalesce(F.col(c) == LEGACY, F.lit(False)) for c in ("model", "config", "code")]
    missing = F.col("model").isNull() | (F.coalesce("run", F.lit("")) == "")
    found = F.when(one[0] & one[1] & one[2], "LEGACY").when(one[0] | one[1] | one[2], "MIXED").when(missing, "MISSING").otherwise("VERSIONED")
    return _ids(spark, sf).select("c_custkey", found.alias("schema_class"))


@query("year_range", "h_obs", "SELECT series_id, d, v FROM h_obs WHERE year(d) BETWEEN 1996 AND 1998")
def year_range(spark, sf):
    return h_obs(spark, sf).where(F.year("d").between(1996, 1998))


@query("future_timestamps", "", "SELECT event_id, ts + to_minutes(CAST(event_id % 11 AS INTEGER)) > ts + INTERVAL 5 MINUTE AS future FROM events")
def future_timestamps(spark, sf):
    """A source's clock more than five minutes ahead of the fetch."""
    source = F.expr("ts + make_dt_interval(0, 0, cast(event_id % 11 as int))")
    return table(spark, sf, "events").select("event_id", (source > F.expr("ts + interval 5 minutes")).alias("future"))


@query("cacheable_live", "", """
    WITH x AS (SELECT user_id, bool_and(event_type <> 'error') AS ok, string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (event_type = 'error') AS failed, bool_or(value > 90) AS high, max(event_id) % 3 AS c FROM events GROUP BY 1)
    SELECT user_id, ok AS cacheable, failed, CASE WHEN c > 0 THEN 'UNKNOWN' WHEN high THEN 'STRESSED' ELSE 'NORMAL' END AS stress,
        CASE c WHEN 1 THEN 'LIVE_STRESS_CACHE_STALE' WHEN 2 THEN 'LIVE_STRESS_REFRESH_FAILED' END AS unavailable FROM x""")
def cacheable_live(spark, sf):
    """Quotes may be cached if all are sound; a cached stress state that is not fresh is unknown."""
    bad = F.col("event_type") == "error"
    x = table(spark, sf, "events").groupBy("user_id").agg(F.bool_and(~bad).alias("cacheable"), F.max(F.when(bad, "error")).alias("failed"), F.bool_or(F.col("value") > 90).alias("high"), (F.max("event_id") % 3).alias("c"))
    stress = F.when(F.col("c") > 0, "UNKNOWN").when(F.col("high"), "STRESSED").otherwise("NORMAL")
    marker = F.when(F.col("c") == 1, "LIVE_STRESS_CACHE_STALE").when(F.col("c") == 2, "LIVE_STRESS_REFRESH_FAILED")
    return x.select("user_id", "cacheable", "failed", stress.alias("stress"), marker.alias("unavailable"))


# ---------------------------------------------------------------- payload rows


@query("csv_quotes", "", r"""
    WITH p AS (SELECT o_orderkey, 'Symbol,Date,Time,Open,High,Low,Close' || chr(13) || chr(10) || 'X,' || CASE WHEN o_orderkey % 7 = 0 THEN '1998-02-31' ELSE strftime(o_orderdate, '%Y-%m-%d') END || ','
        || CASE WHEN o_orderkey % 5 = 0 THEN '25:00:00' ELSE '16:30:00' END || ',1,2,3,' || CASE WHEN o_orderkey % 3 = 0 THEN 'N/D' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END || chr(10) AS body FROM orders),
    c AS (SELECT o_orderkey, string_split(string_split(regexp_replace(trim(body, chr(10) || chr(13) || ' '), '\r', '', 'g'), chr(10))[-1], ',') AS c FROM p)
    SELECT o_orderkey, try_cast(c[7] AS DOUBLE) AS value, try_strptime(c[2] || 'T' || c[3], '%Y-%m-%dT%H:%M:%S') AS source_at FROM c WHERE try_cast(c[7] AS DOUBLE) IS NOT NULL AND try_strptime(c[2] || 'T' || c[3], '%Y-%m-%dT%H:%M:%S') IS NOT NULL""")
def csv_quotes(spark, sf):
    """The last line of a quote response: date, clock and price, all valid or no quote."""
    k = F.col("o_orderkey")
    date = F.when(k % 7 == 0, "1998-02-31").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    price = F.when(k % 3 == 0, "N/D").otherwise(F.floor("o_totalprice").cast("string"))
    body = F.concat(F.lit("Symbol,Date,Time,Open,High,Low,Close\r\nX,"), date, F.lit(","), F.when(k % 5 == 0, "25:00:00").otherwise("16:30:00"), F.lit(",1,2,3,"), price, F.lit("\n"))
    return table(spark, sf, "orders").select("o_orderkey", csv_quote(body).alias("q")).where("q is not null").select("o_orderkey", "q.*")


def csv_quote(body: Column) -> Column:
    lines = F.split(F.regexp_replace(body, r"^\s+|\s+$", ""), r"\r?\n")
    cols = F.split(F.element_at(lines, -1), ",")
    value = F.get(cols, 6).try_cast("double")
    at = F.try_to_timestamp(F.concat(F.get(cols, 1), F.lit("T"), F.get(cols, 2)), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return F.when((F.size(lines) >= 2) & value.isNotNull() & ~F.isnan(value) & at.isNotNull(), F.struct(value.alias("value"), at.cast("timestamp_ntz").alias("source_at")))


@query("csv_histories", "", """
    WITH l AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber = 6 THEN '1998-02-31' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS d, CASE WHEN l_linenumber = 2 THEN 'null' ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) END AS v FROM lineitem),
    ok AS (SELECT k, max(d) AS last FROM l GROUP BY k HAVING bool_and(try_strptime(d, '%Y-%m-%d') IS NOT NULL))
    SELECT k, try_cast(d AS DATE) AS d, try_cast(v AS DOUBLE) AS v FROM l JOIN ok USING (k) WHERE try_cast(v AS DOUBLE) IS NOT NULL AND try_cast(d AS DATE) >= try_cast(last AS DATE) - 45""")
def csv_histories(spark, sf):
    """Lines date,price of a response: an invalid date voids all of it; the last 45 days stay."""
    n = F.col("l_linenumber")
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), S.strict_date(F.when(n == 6, "1998-02-31").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))).alias("d"),
        F.when(n == 2, "null").otherwise(F.floor("l_extendedprice").cast("string")).try_cast("double").alias("v"),
    )
    ok = lines.groupBy("k").agg(F.max("d").alias("last"), F.bool_and(F.col("d").isNotNull()).alias("ok")).where("ok").select("k", "last")
    return lines.join(ok, "k").where("v is not null and d >= date_add(last, -45)").select("k", "d", "v")


@query("official_quotes", "h_obs", """
    WITH n AS (SELECT max(d) + 3 AS today FROM h_obs), x AS (SELECT series_id, max(d) AS d, arg_max(v, d) AS v FROM h_obs, n WHERE d >= today - 45 GROUP BY 1)
    SELECT series_id, d, v, today - d AS age, CASE WHEN today - d > CASE WHEN series_id < '3' THEN 3 ELSE 4 END THEN 'STALE' ELSE 'OK' END AS status FROM x, n""")
def official_quotes(spark, sf):
    """The last point of the last 45 days, with the age that its instrument may have."""
    rows = h_obs(spark, sf)
    today = F.broadcast(rows.agg(F.date_add(F.max("d"), 3).alias("today")))  # one row
    x = rows.join(today).where("d >= date_add(today, -45)").groupBy("series_id", "today").agg(F.max("d").alias("d"), F.max_by("v", "d").alias("v"))
    age = F.datediff("today", "d").cast("long")
    return x.select("series_id", "d", "v", age.alias("age"), F.when(age > F.when(F.col("series_id") < "3", 3).otherwise(4), "STALE").otherwise("OK").alias("status"))


@query("checkpoint_maxima", "h_pit", "SELECT series_id, max(obs_date) AS obs_date, max(vintage_date) AS vintage_date FROM h_pit GROUP BY 1")
def checkpoint_maxima(spark, sf):
    return h_pit(spark, sf).groupBy("series_id").agg(F.max("obs_date").alias("obs_date"), F.max("vintage_date").alias("vintage_date"))


@query("meta_map", "", "SELECT string_agg(CAST(r_regionkey AS VARCHAR) || '=' || r_name, ';' ORDER BY r_regionkey) AS meta FROM region")
def meta_map(spark, sf):
    """The key-value table as one map, shown in the order of its keys."""
    pairs = table(spark, sf, "region").agg(F.map_from_entries(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("m"))
    shown = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"]))
    return pairs.select(F.array_join(shown, ";").alias("meta"))


@query("release_rule_lists", "", """
    SELECT n_regionkey AS series, string_agg(CAST(n_nationkey AS VARCHAR) || ':' || n_name, ',' ORDER BY n_nationkey) AS rules, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY 1""")
def release_rule_lists(spark, sf):
    """The rules of each series in the order in which they come into force."""
    listed = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("series")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    return listed.select("series", F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["n_nationkey"].cast("string"), x["n_name"])), ",").alias("rules"), F.size("l").cast("long").alias("n"))


@query("earnings_momentum", "h_obs", """
    WITH a AS (SELECT o.series_id, o.d, c.v AS cur FROM h_obs o ASOF JOIN h_obs c ON o.series_id = c.series_id AND c.d <= o.d - 60),
    b AS (SELECT a.*, p.v AS base FROM a ASOF JOIN h_obs p ON a.series_id = p.series_id AND p.d <= a.d - 425)
    SELECT series_id, d, round((cur - base) / abs(base), 6) AS momentum FROM b WHERE base <> 0""")
def earnings_momentum(spark, sf):
    """Growth over a year of what was published 60 days ago."""
    rows = h_obs(spark, sf)
    probe = rows.select("series_id", "d", F.date_add("d", -60).alias("now"), F.date_add("d", -425).alias("then"))
    got = A.asof_last(A.asof_last(probe, rows, keys=["series_id"], on="now", carry=["v"], prefix="c_"), rows, keys=["series_id"], on="then", carry=["v"], prefix="b_")
    return got.where("b_v <> 0 and c_v is not null").select("series_id", "d", r6((F.col("c_v") - F.col("b_v")) / F.abs("b_v"), "momentum"))


# ---------------------------------------------------------------- stored tables


@query("top_correlations", "h_factor", """
    WITH x AS (SELECT a.factor AS f1, b.factor AS f2, corr(a.f, b.f) AS r FROM h_factor a JOIN h_factor b ON a.w = b.w AND a.factor < b.factor GROUP BY 1, 2)
    SELECT f1, f2, round(r, 6) AS r FROM x ORDER BY abs(r) DESC LIMIT 3""")
def top_correlations(spark, sf):
    f = h_factor(spark, sf)
    a, b = f.select("w", F.col("factor").alias("f1"), F.col("f").alias("x")), f.select("w", F.col("factor").alias("f2"), F.col("f").alias("y"))
    found = a.join(b, "w").where("f1 < f2").groupBy("f1", "f2").agg(F.corr("x", "y").alias("r"))
    return found.orderBy(F.abs("r").desc()).limit(3).select("f1", "f2", r6("r", "r"))


@query("last_run_by_status", "", """
    SELECT event_type AS status, event_id AS run_id, ts AS started FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1""")
def last_run_by_status(spark, sf):
    last = table(spark, sf, "events").groupBy(F.col("event_type").alias("status")).agg(F.max(F.struct("ts", "event_id")).alias("x"))
    return last.select("status", F.col("x.event_id").alias("run_id"), F.col("x.ts").alias("started"))


@query("governed_snapshots", "h_signal", "SELECT idx, d, decision_at, score FROM h_signal WHERE idx % 7 <> 0 ORDER BY decision_at, d LIMIT 601")
def governed_snapshots(spark, sf):
    """One row more than the 600 that a study takes, so that too many are seen."""
    return h_signal(spark, sf).where("idx % 7 <> 0").select("idx", "d", "decision_at", "score").orderBy("decision_at", "d").limit(601)


@query("run_counts", "", "SELECT user_id AS run_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT event_type) AS BIGINT) AS n_series FROM events GROUP BY 1")
def run_counts(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("event_type").alias("n_series"))


@query("bootstrap_counts", "", """
    SELECT l_suppkey AS source, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_series FROM lineitem GROUP BY 1 HAVING count(*) > count(DISTINCT l_orderkey)""")
def bootstrap_counts(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("n_series"))
    return rows.where("n > n_series")


@query("snapshot_count", "h_signal", "SELECT CAST(count(*) AS BIGINT) AS n FROM h_signal")
def snapshot_count(spark, sf):
    return h_signal(spark, sf).agg(F.count(F.lit(1)).alias("n"))


@query("chart_series", "h_signal h_vix", """
    SELECT 'score' AS kind, d, score AS value FROM h_signal WHERE idx % 6 <> 0 UNION ALL SELECT 'vix', s.d, v.v FROM h_signal s JOIN h_vix v ON v.d = s.d""")
def chart_series(spark, sf):
    from .harness import h_vix

    rows = h_signal(spark, sf).select("d", F.when(F.col("idx") % 6 != 0, F.col("score")).alias("score")).join(h_vix(spark, sf), "d", "left")
    part = lambda kind, c: rows.where(F.col(c).isNotNull()).select(F.lit(kind).alias("kind"), "d", F.col(c).alias("value"))
    return part("score", "score").unionByName(part("vix", "v"))


@query("frozen_cutoffs", "h_signal h_price", """
    SELECT 'weekly' AS kind, max(decision_at) AS cutoff, CAST(count(*) AS BIGINT) AS n FROM h_signal UNION ALL SELECT 'daily', max(CAST(d AS TIMESTAMP) + INTERVAL 22 HOUR), CAST(count(*) AS BIGINT) FROM h_price""")
def frozen_cutoffs(spark, sf):
    """What is frozen, by week or by day: nothing at or before these instants may be added."""
    weekly = h_signal(spark, sf).select(F.lit("weekly").alias("kind"), "decision_at")
    daily = h_price(spark, sf).select(F.lit("daily").alias("kind"), S.at_time("d", "22:00:00").alias("decision_at"))
    return weekly.unionByName(daily).groupBy("kind").agg(F.max("decision_at").alias("cutoff"), F.count(F.lit(1)).alias("n"))


@query("verdict_anchors", "h_price h_signal", "SELECT p.d, p.close, s.verdict FROM h_price p LEFT JOIN h_signal s ON s.d = p.d WHERE p.d BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'")
def verdict_anchors(spark, sf):
    """The range is the caller's."""
    days = h_price(spark, sf).where("d between date'1996-01-01' and date'1999-12-31'")
    return days.join(h_signal(spark, sf).select("d", "verdict"), "d", "left").select("d", "close", "verdict")


@query("active_latest_mismatch", "h_pit", """
    WITH l AS (SELECT series_id, obs_date, arg_max(value, vintage_date) AS value FROM h_pit GROUP BY 1, 2), a AS (SELECT series_id, obs_date, value + CASE WHEN day(obs_date) = 13 THEN 1 ELSE 0 END AS value FROM l)
    SELECT a.series_id, CAST(count(*) AS BIGINT) AS mismatches FROM a ANTI JOIN l ON a.series_id = l.series_id AND a.obs_date = l.obs_date AND a.value = l.value GROUP BY 1""")
def active_latest_mismatch(spark, sf):
    """Active values that are not those of the latest vintage; an activation may have none."""
    latest = h_pit(spark, sf).groupBy("series_id", "obs_date").agg(F.max_by("value", "vintage_date").alias("value"))
    active = latest.withColumn("value", F.col("value") + F.when(F.dayofmonth("obs_date") == 13, 1).otherwise(0))
    return active.join(latest, ["series_id", "obs_date", "value"], "left_anti").groupBy("series_id").agg(F.count(F.lit(1)).alias("mismatches"))
