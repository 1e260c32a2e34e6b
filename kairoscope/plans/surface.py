"""Queries: scores and decisions, explanations, sources, sinks, event windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import params as P
from ..functions import scalars as S
from ..functions import scores as C
from ..operators import sets as T
from ..operators import windows as N
from ..sources import readers as R
from ..sources import sinks as K
from ..streaming import ingest as G
from .harness import h_factor, h_obs, h_price, h_signal, h_week, query, r6, table


@query("factor_scores", "h_week h_obs", """
    WITH x AS (SELECT series_id, w, v / 100000 AS u, v - lag(v, 4) OVER y AS c, lag(v, 4) OVER y AS p FROM h_week WINDOW y AS (PARTITION BY series_id ORDER BY w))
    SELECT series_id, w, round(greatest(0, least(100, (u - 2.8) / (3.8 - 2.8) * 100)), 6) AS level_score,
        round(greatest(0, least(100, (u - 0.1) / (0 - 0.1) * 100)), 6) AS funding,
        round(CASE WHEN c IS NULL THEN 50 ELSE greatest(0, least(100, (c / 100000 - 0.5) / -1.0 * 100)) END, 6)::DOUBLE AS rates,
        round(greatest(0, least(100, (u * 10 - 30) / (12 - 30) * 100)), 6) AS vol,
        round(coalesce(greatest(0, least(100, (u + 0.5) / 2 * 100)), 50) * 0.5 + CASE WHEN c IS NULL THEN 50 ELSE greatest(0, least(100, (c / 100000 + 0.3) / 0.6 * 100)) END * 0.5, 6)::DOUBLE AS curve,
        round(CASE WHEN c IS NULL THEN greatest(0, least(100, (u + 0.5) / 2 * 100)) ELSE greatest(0, least(100, (u + 0.5) / 2 * 100)) * 0.5 + greatest(0, least(100, (c / 100000 + 0.3) / 0.6 * 100)) * 0.5 END, 6) AS curve_available FROM x""")
def factor_scores(spark, sf):
    x = h_week(spark, sf).select("series_id", "w", (F.col("v") / 100000).alias("u"), ((F.col("v") - N.lag("v", 4, ["series_id"], "w")) / 100000).alias("c"))
    return x.select(
        "series_id", "w", r6(S.lin_map("u", 2.8, 3.8), "level_score"), r6(C.funding_score("u"), "funding"), r6(C.rates_score("c"), "rates"),
        r6(C.vol_score(F.col("u") * 10), "vol"), r6(C.curve_score("u", "c"), "curve"), r6(C.available_curve_score("u", "c"), "curve_available"),
    )


@query("dollar_score", "h_obs", """
    SELECT series_id, d, CASE WHEN count(*) OVER x < 200 THEN 50 WHEN stddev_pop(v) OVER x = 0 THEN 50 ELSE
        round(greatest(0, least(100, ((v - avg(v) OVER x) / stddev_pop(v) OVER x - 1) / -2 * 100)), 6) END AS score FROM h_obs WINDOW x AS (PARTITION BY series_id ORDER BY d ROWS 199 PRECEDING)""")
def dollar_score(spark, sf):
    w = W.partitionBy("series_id").orderBy("d").rowsBetween(-199, 0)
    rows = h_obs(spark, sf).select("series_id", "d", "v", F.avg("v").over(w).alias("m"), F.stddev_pop("v").over(w).alias("s"), F.count("v").over(w).alias("n"))
    return rows.select("series_id", "d", r6(C.dollar_score("v", "m", "s", "n"), "score"))


@query("credit_score", "h_week", """
    WITH x AS (SELECT a.series_id, a.w, any_value(a.v) AS v, count(*) FILTER (b.v <= a.v) / count(*) AS share FROM h_week a JOIN h_week b ON a.series_id = b.series_id AND b.w <= a.w GROUP BY 1, 2),
    c AS (SELECT *, (v - lag(v, 3) OVER (PARTITION BY series_id ORDER BY w)) / 100000 AS ch FROM x)
    SELECT series_id, w, round(greatest(0, least(100, (1 - share) * 55 + CASE WHEN ch IS NULL THEN 50 ELSE greatest(0, least(100, (ch - 1) / -1.25 * 100)) END * 0.45 - CASE WHEN share < 0.15 AND ch > 0.2 THEN 15 ELSE 0 END)), 6)::DOUBLE AS full_score,
        round(CASE WHEN ch IS NULL THEN (1 - share) * 100 ELSE greatest(0, least(100, (1 - share) * 55 + greatest(0, least(100, (ch - 1) / -1.25 * 100)) * 0.45 - CASE WHEN share < 0.15 AND ch > 0.2 THEN 15 ELSE 0 END)) END, 6)::DOUBLE AS available_score FROM c""")
def credit_score(spark, sf):
    rows = N.expanding_share(h_week(spark, sf), "v", ["series_id"], "w")
    rows = rows.withColumn("ch", (F.col("v") - N.lag("v", 3, ["series_id"], "w")) / 100000)
    return rows.select("series_id", "w", r6(C.credit_score("share", "ch"), "full_score"), r6(C.available_credit_score("share", "ch"), "available_score"))


WEIGHTED = "w(factor, wt) AS (VALUES ('1-URGENT', 0.35::DOUBLE), ('2-HIGH', 0.18), ('3-MEDIUM', 0.15), ('4-NOT SPECIFIED', 0.06), ('5-LOW', 0.0))"
_WEIGHTS = [("1-URGENT", 0.35), ("2-HIGH", 0.18), ("3-MEDIUM", 0.15), ("4-NOT SPECIFIED", 0.06), ("5-LOW", 0.0)]


def _weights(spark):
    return F.broadcast(spark.createDataFrame(_WEIGHTS, "factor string, wt double"))


@query("available_weight_score", "h_factor", f"""WITH {WEIGHTED}
    SELECT f.w, round(sum(f * wt) FILTER (wt > 0 AND f > 20) / nullif(sum(wt) FILTER (wt > 0 AND f > 20), 0), 6) AS score,
        round(count(*) FILTER (f > 20) / 5, 6) AS coverage FROM h_factor f JOIN w USING (factor) GROUP BY 1""")
def available_weight_score(spark, sf):
    rows = h_factor(spark, sf).join(_weights(spark), "factor")
    ok = (F.col("wt") > 0) & (F.col("f") > 20)
    return rows.groupBy("w").agg(
        r6(F.try_divide(F.sum(F.when(ok, F.col("f") * F.col("wt"))), F.sum(F.when(ok, F.col("wt")))), "score"), r6(F.count_if(F.col("f") > 20) / F.lit(5.0), "coverage")
    )


@query("factor_contributions", "h_factor", f"""WITH {WEIGHTED}, c AS (SELECT f.w, factor, (f - 50) * wt / sum(wt) OVER (PARTITION BY f.w) AS c FROM h_factor f JOIN w USING (factor) WHERE wt > 0)
    SELECT w, factor, round(c, 6) AS contribution, CAST(row_number() OVER (PARTITION BY w ORDER BY round(abs(c), 6) DESC, factor) AS BIGINT) AS place FROM c""")
def factor_contributions(spark, sf):
    rows = h_factor(spark, sf).join(_weights(spark), "factor").where("wt > 0")
    c = (F.col("f") - 50) * F.col("wt") / F.sum("wt").over(W.partitionBy("w"))
    rows = rows.select("w", "factor", r6(c, "contribution"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("w").orderBy(F.abs("contribution").desc(), "factor")).cast("long"))


@query("score_attribution", "h_factor", f"""WITH {WEIGHTED}, j AS (SELECT a.w, factor, wt, a.f - b.f AS df FROM h_factor a JOIN h_factor b USING (factor) JOIN w USING (factor) WHERE b.w = a.w - 28 AND wt > 0)
    SELECT w, factor, round(df * wt / sum(wt) OVER (PARTITION BY w), 6) AS change,
        round(sum(df * wt) OVER (PARTITION BY w ORDER BY factor ROWS UNBOUNDED PRECEDING) / sum(wt) OVER (PARTITION BY w), 6) AS running FROM j""")
def score_attribution(spark, sf):
    f = h_factor(spark, sf)
    old = f.select("factor", F.date_add("w", 28).alias("w"), F.col("f").alias("before"))
    rows = f.join(old, ["factor", "w"]).join(_weights(spark), "factor").where("wt > 0").withColumn("x", (F.col("f") - F.col("before")) * F.col("wt"))
    total = F.sum("wt").over(W.partitionBy("w"))
    run = F.sum("x").over(W.partitionBy("w").orderBy("factor").rowsBetween(W.unboundedPreceding, 0))
    return rows.select("w", "factor", r6(F.col("x") / total, "change"), r6(run / total, "running"))


@query("top_factors", "h_factor", """
    SELECT w, factor, printf('%s %.2f', factor, f) AS label FROM h_factor QUALIFY row_number() OVER (PARTITION BY w ORDER BY f DESC, factor) <= 3""")
def top_factors(spark, sf):
    r = F.row_number().over(W.partitionBy("w").orderBy(F.col("f").desc(), "factor"))
    return h_factor(spark, sf).withColumn("r", r).where("r <= 3").select("w", "factor", F.format_string("%s %.2f", "factor", "f").alias("label"))


@query("decision_state", "h_signal", """
    WITH s AS (SELECT *, CASE WHEN idx % 11 = 0 THEN 'UNKNOWN' WHEN idx % 3 = 0 THEN 'STRESSED' ELSE 'NORMAL' END AS stress, CASE WHEN idx % 13 = 0 THEN 'DATA_INCOMPLETE' ELSE 'OK' END AS status,
        CASE WHEN idx % 2 = 0 THEN 'UP' ELSE 'DOWN' END AS dir FROM h_signal),
    b AS (SELECT *, CASE WHEN verdict = 'BULLISH' AND dir = 'DOWN' THEN 0.9 WHEN verdict = 'BULLISH' THEN 1.0 WHEN verdict = 'BEARISH' THEN 0.25 WHEN score < 50 THEN 0.5 ELSE 0.75 END AS base FROM s)
    SELECT idx, CASE WHEN status <> 'OK' OR stress = 'UNKNOWN' THEN 'UNKNOWN' WHEN stress = 'STRESSED' AND score < 65 THEN CASE verdict WHEN 'BULLISH' THEN 'NEUTRAL' ELSE 'BEARISH' END ELSE verdict END AS shown,
        CAST(CASE WHEN stress = 'STRESSED' AND score < 65 THEN 0.25 WHEN stress = 'UNKNOWN' AND base > 0.75 THEN 0.75 ELSE base END AS DOUBLE) AS exposure FROM b""")
def decision_state(spark, sf):
    i = F.col("idx")
    rows = h_signal(spark, sf).select(
        "idx", "verdict", "score", F.when(i % 11 == 0, "UNKNOWN").when(i % 3 == 0, "STRESSED").otherwise("NORMAL").alias("stress"),
        F.when(i % 13 == 0, "DATA_INCOMPLETE").otherwise("OK").alias("status"), F.when(i % 2 == 0, "UP").otherwise("DOWN").alias("dir"),
    )
    return rows.select("idx", C.display_verdict("verdict", "score", "stress", "status").alias("shown"), C.exposure("verdict", "dir", "score", "stress").alias("exposure"))


@query("shadow_exposure", "h_signal", """
    WITH s AS (SELECT idx, target_exposure AS base, score AS t, (idx * 37) % 101 AS c FROM h_signal),
    h AS (SELECT *, greatest(0.25, least(1, base + CASE WHEN t >= 60 AND c >= 60 THEN 0.1 WHEN t <= 40 THEN -0.1 ELSE 0 END)) AS e FROM s)
    SELECT idx, round(CASE WHEN c < 40 THEN least(e, 0.75) ELSE e END, 6)::DOUBLE AS exposure FROM h""")
def shadow_exposure(spark, sf):
    rows = h_signal(spark, sf).withColumn("c", (F.col("idx") * 37) % 101)
    return rows.select("idx", r6(C.shadow_exposure("target_exposure", "score", "c"), "exposure"))


@query("reserve_states", "h_factor", """
    SELECT CASE WHEN f >= 80 THEN 'ABUNDANT' WHEN f >= 60 THEN 'AMPLE' WHEN f >= 40 THEN 'TRANSITION' WHEN f >= 20 THEN 'SCARCE' ELSE 'STRESSED' END AS state, CAST(count(*) AS BIGINT) AS n FROM h_factor GROUP BY 1""")
def reserve_states(spark, sf):
    return h_factor(spark, sf).groupBy(C.reserve_state("f").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("agreement_classes", "h_week", """
    WITH c AS (SELECT w, sign(v - lag(v) OVER x) AS a, sign(v - lag(v, 4) OVER x) AS b FROM h_week WHERE series_id = '1-URGENT' WINDOW x AS (ORDER BY w))
    SELECT CASE WHEN a IS NULL OR b IS NULL OR a = 0 OR b = 0 THEN 'TRANSITION' WHEN a = b THEN 'HIGH' ELSE 'LOW' END AS agreement, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY 1""")
def agreement_classes(spark, sf):
    rows = h_week(spark, sf).where("series_id = '1-URGENT'")
    step = lambda n: C.sign_class(F.col("v") - N.lag("v", n, [], "w"))
    rows = rows.select(step(1).alias("a"), step(4).alias("b"))
    return rows.groupBy(C.agreement("a", "b").alias("agreement")).agg(F.count(F.lit(1)).alias("n"))


@query("provenance_summary", "", """
    SELECT o_orderpriority AS priority, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS governed, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS legacy,
        CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS invalid, max(o_orderdate) AS last_fetch, CAST(count(DISTINCT o_custkey) AS BIGINT) AS runs,
        array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') AS sources FROM orders GROUP BY 1""")
def provenance_summary(spark, sf):
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count_if(s == "F").alias("governed"), F.count_if(s == "O").alias("legacy"), F.count_if(s == "P").alias("invalid"),
        F.max("o_orderdate").alias("last_fetch"), F.count_distinct("o_custkey").alias("runs"), F.array_join(F.array_sort(F.collect_set(s)), ",").alias("sources"),
    )


@query("provider_choice", "", """
    WITH c AS (SELECT user_id, event_id AS priority, event_type AS provider, value, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'STALE' ELSE 'OK' END AS status FROM events)
    SELECT user_id, priority, provider, status FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE status WHEN 'OK' THEN 0 WHEN 'STALE' THEN 1 ELSE 2 END, priority) = 1""")
def provider_choice(spark, sf):
    t = F.col("event_type")
    status = F.when(t == "error", "FAILED").when(t == "view", "STALE").otherwise("OK")
    rows = table(spark, sf, "events").select("user_id", F.col("event_id").alias("priority"), t.alias("provider"), status.alias("status"))
    return R.provider_choice(rows, ["user_id"])


@query("json_props", "", """
    SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, CAST(count(*) FILTER (CAST(json_extract(props, '$.k') AS BIGINT) > 50) AS BIGINT) AS above FROM events GROUP BY 1""")
def json_props(spark, sf):
    k = F.from_json("props", "map<string,bigint>")["k"]
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count_if(k > 50).alias("above"))


@query("tumbling_window", "", """
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_window(spark, sf):
    return G.tumbling(table(spark, sf, "events"), width="1 hour").withColumn("total", F.round("total", 4))


@query("sliding_window", "", """
    SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(CAST(30 * k AS BIGINT)) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events, range(0, 2) r(k) GROUP BY 1, 2""")
def sliding_window(spark, sf):
    return G.sliding(table(spark, sf, "events"), width="1 hour", step="30 minutes").withColumn("total", F.round("total", 4))


@query("session_window", "", """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")
def session_window(spark, sf):
    return G.sessions(table(spark, sf, "events"), gap="2 hours")


@query("rate_limit", "", """
    WITH w AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) AS start, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 6 HOUR, ts) ORDER BY ts, event_id) AS n FROM events)
    SELECT user_id, start, CAST(max(n) AS BIGINT) AS requests, CAST(count(*) FILTER (n > 3) AS BIGINT) AS rejected FROM w GROUP BY 1, 2""")
def rate_limit(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.window("ts", "6 hours")["start"].alias("start"))
    n = F.count(F.lit(1))
    return rows.groupBy("user_id", "start").agg(n.alias("requests"), F.greatest(n - 3, F.lit(0)).alias("rejected"))


@query("health_verdict", "", """
    WITH e AS (SELECT user_id, max(ts) AS last, arg_max(event_type, ts) AS status, count(*) AS n FROM events GROUP BY 1)
    SELECT user_id, status, n > 0 AND status <> 'error' AND last > TIMESTAMP '2024-01-30 18:00:00' AS healthy FROM e""")
def health_verdict(spark, sf):
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last"), F.max_by("event_type", "ts").alias("status"), F.count(F.lit(1)).alias("n"))
    fresh = F.col("last") > F.lit("2024-01-30 18:00:00").cast("timestamp")
    return rows.select("user_id", "status", ((F.col("n") > 0) & (F.col("status") != "error") & fresh).alias("healthy"))


@query("alert_on_second_failure", "", """
    WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM
        (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE event_type = 'error' AND before = 'error'),
    a AS (SELECT user_id, 1::BIGINT AS rn UNION ALL
        SELECT a.user_id, min(x.rn) FROM a JOIN e y ON y.user_id = a.user_id AND y.rn = a.rn JOIN e x ON x.user_id = y.user_id AND x.ts >= y.ts + INTERVAL 12 HOUR GROUP BY a.user_id, a.rn)
    SELECT e.event_id, e.user_id FROM e JOIN a ON a.user_id = e.user_id AND a.rn = e.rn""".replace("SELECT user_id, 1::BIGINT AS rn UNION", "SELECT DISTINCT user_id, 1::BIGINT AS rn FROM e UNION"))
def alert_on_second_failure(spark, sf):
    """A failure after a failure gives an alert, but none within 12 hours of the last."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", F.lag("event_type").over(w).alias("before"))
    failures = rows.where("event_type = 'error' and before = 'error'").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("f"))
    alerts = F.expr("""aggregate(f, named_struct('last', CAST(NULL AS TIMESTAMP), 'out', CAST(array() AS ARRAY<BIGINT>)),
        (s, x) -> IF(s.last IS NULL OR CAST(x.ts AS TIMESTAMP) >= s.last + INTERVAL 12 HOURS, named_struct('last', CAST(x.ts AS TIMESTAMP), 'out', array_append(s.out, x.event_id)), s), s -> s.out)""")
    return failures.select(F.explode(alerts).alias("event_id"), "user_id")


@query("csv_export", "h_signal", """
    SELECT concat_ws(',', CAST(idx AS VARCHAR), CASE WHEN idx % 4 = 0 THEN '' ELSE verdict END, CASE WHEN idx % 3 = 0 THEN '"''=a,b"' ELSE 'plain' END, CASE WHEN idx % 5 = 0 THEN '"say ""x""' || chr(34) ELSE '''+1' END) AS line FROM h_signal""")
def csv_export(spark, sf):
    i = F.col("idx")
    rows = h_signal(spark, sf).select("idx", F.when(i % 4 != 0, F.col("verdict")).alias("v"), F.when(i % 3 == 0, "=a,b").otherwise("plain").alias("a"), F.when(i % 5 == 0, 'say "x"').otherwise("+1").alias("b"))
    return K.csv_lines(rows, ["idx", "v", "a", "b"])


_SQL = lambda p: p.replace("'", "''")


@query("redacted_text", "", f"""
    SELECT doc_id, substr(regexp_replace(regexp_replace(text, '{_SQL(S.SECRET)}', '\\1[REDACTED]', 'g'), '{_SQL(S.BEARER)}', 'Bearer [REDACTED]', 'g'), 1, 512) AS redacted FROM documents""")
def redacted_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.redact("text").alias("redacted"))


@query("challenge_pages", "", r"""
    WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN 'Date,Close' || chr(10) || '2024-01-02,1' WHEN 2 THEN repeat('a', 250) || '<script' ELSE chr(10) || ' x _CF_CHL_opt' END AS body,
        CASE WHEN page_id % 11 = 0 THEN 'Application/JavaScript' WHEN page_id % 13 = 0 THEN 'TEXT/HTML; charset=utf-8' WHEN page_id % 3 = 0 THEN 'text/csv' END AS kind FROM pages),
    h AS (SELECT page_id, lower(coalesce(kind, '')) AS t, lower(substr(regexp_replace(body, '^\s+', ''), 1, 256)) AS x FROM p)
    SELECT page_id, contains(t, 'text/html') OR contains(t, 'javascript') OR starts_with(x, '<!doctype html') OR starts_with(x, '<html') OR contains(x, '<script') OR contains(x, '_cf_chl_') AS challenge FROM h""")
def challenge_pages(spark, sf):
    k = F.col("page_id")
    body = F.when(k % 4 == 0, F.col("html")).when(k % 4 == 1, "Date,Close\n2024-01-02,1").when(k % 4 == 2, "a" * 250 + "<script").otherwise("\n x _CF_CHL_opt")
    kind = F.when(k % 11 == 0, "Application/JavaScript").when(k % 13 == 0, "TEXT/HTML; charset=utf-8").when(k % 3 == 0, "text/csv")
    return table(spark, sf, "pages").select("page_id", R.challenge_page(body, kind).alias("challenge"))


@query("series_manifest", "h_obs", """
    SELECT series_id, CAST(count(*) AS BIGINT) AS n, min(d) AS first, max(d) AS last, sha256(string_agg(CAST(d AS VARCHAR) || ',' || CAST(CAST(round(v) AS BIGINT) AS VARCHAR), chr(10) ORDER BY d)) AS hash FROM h_obs GROUP BY 1""")
def series_manifest(spark, sf):
    return R.manifest(h_obs(spark, sf).withColumn("v", F.round("v").cast("long")), ["series_id"])


@query("row_checksums", "", """
    SELECT c_custkey, sha256(concat_ws('|', c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR))) AS checksum FROM customer""")
def row_checksums(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.checksum(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("checksum"))


@query("loose_dates", "", """
    WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%-m/%-d/%Y') ELSE 'n/a' END AS raw FROM orders)
    SELECT o_orderkey, coalesce(CAST(try_strptime(raw, '%Y-%m-%d') AS DATE), CAST(try_strptime(raw, '%Y-%m') AS DATE), CAST(try_strptime(raw, '%-m/%-d/%Y') AS DATE)) AS d FROM t""")
def loose_dates(spark, sf):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy-MM")).when(k == 2, F.date_format(d, "M/d/yyyy")).otherwise("n/a")
    return table(spark, sf, "orders").select("o_orderkey", S.loose_date(raw).alias("d"))


@query("current_series_json", "h_obs", """
    SELECT series_id, d, CASE WHEN series_id = '1-URGENT' THEN v / 1000 ELSE v END AS v FROM h_obs WHERE day(d) % 7 <> 0""")
def current_series_json(spark, sf):
    value = F.when(F.dayofmonth("d") % 7 == 0, ".").otherwise(F.col("v").cast("string"))
    item = F.struct(F.col("d").cast("string").alias("date"), value.alias("value"))
    month = F.date_trunc("month", "d")
    raw = h_obs(spark, sf).groupBy("series_id", month).agg(F.to_json(F.struct(F.collect_list(item).alias("observations"))).alias("payload"))
    return R.json_series(raw, {"1-URGENT": "M"})


@query("wide_vintage_unpivot", "h_pit", """
    SELECT series_id, obs_date, vintage_date, value FROM h_pit WHERE obs_date < DATE '1995-07-01'""")
def wide_vintage_unpivot(spark, sf):
    from .harness import h_pit

    return _unpivot(h_pit(spark, sf).where("obs_date < date'1995-07-01'"))


@query("wide_vintage_unpivot_all", "h_pit", "SELECT series_id, obs_date, vintage_date, value FROM h_pit")
def wide_vintage_unpivot_all(spark, sf):
    """``wide_vintage_unpivot`` over every date."""
    from .harness import h_pit

    return _unpivot(h_pit(spark, sf))


def _unpivot(rows):
    name = F.concat(F.lit("X_"), F.date_format("vintage_date", "yyyyMMdd"))
    entry = F.map_from_entries(F.collect_list(F.struct(name, F.col("value").cast("string"))))
    wide = rows.groupBy("series_id", "obs_date").agg(entry.alias("m"))
    wide = wide.withColumn("m", F.map_concat("m", F.create_map(F.lit("date"), F.col("obs_date").cast("string"))))
    raw = wide.groupBy("series_id", F.date_trunc("month", "obs_date")).agg(F.to_json(F.struct(F.collect_list("m").alias("observations"))).alias("payload"))
    return R.wide_vintages(raw)


@query("csv_series_reader", "h_price", "SELECT d, CAST(round(close) AS DOUBLE) AS v, true AS ordered FROM h_price WHERE day(d) % 6 <> 0")
def csv_series_reader(spark, sf):
    rows = h_price(spark, sf).withColumn("n", F.row_number().over(W.orderBy("d")))
    value = F.when(F.dayofmonth("d") % 6 == 0, ".").otherwise(F.round("close").cast("long").cast("string"))
    return R.csv_series(rows.select("n", F.concat_ws(",", F.col("d").cast("string"), value).alias("line")))


@query("release_rule_join", "h_pit", """
    SELECT series_id, obs_date, vintage_date, CASE WHEN vintage_date <= DATE '1998-01-01' THEN '08:30' ELSE '16:30' END AS release_time, CAST(1 AS BIGINT) AS n_rules FROM h_pit WHERE series_id = '2-HIGH'""")
def release_rule_join(spark, sf):
    from .harness import h_pit

    rules = spark.createDataFrame([("2-HIGH", "1900-01-01", "1998-01-01", "08:30"), ("2-HIGH", "1998-01-02", "2100-01-01", "16:30")], "series_id string, a string, b string, release_time string")
    rules = rules.select("series_id", F.to_date("a").alias("valid_from"), F.to_date("b").alias("valid_to"), "release_time")
    rows = h_pit(spark, sf).where("series_id = '2-HIGH'")
    return R.release_rules(rows, rules).select("series_id", "obs_date", "vintage_date", "release_time", "n_rules")


@query("frozen_weeks", "h_week", """
    SELECT w AS week, CASE WHEN week(w) % 5 = 0 THEN v + 1 ELSE v END AS v, week(w) % 5 = 0 AND false AS legacy FROM h_week WHERE series_id = '1-URGENT'""")
def frozen_weeks(spark, sf):
    rows = h_week(spark, sf).where("series_id = '1-URGENT'").select(F.col("w").alias("week"), "v")
    old = rows.withColumn("legacy", F.weekofyear("week") % 5 == 0).where(F.weekofyear("week") % 7 != 3)
    new = rows.select("week", F.when(F.weekofyear("week") % 5 == 0, F.col("v") + 1).otherwise(F.col("v")).alias("v"), F.lit(False).alias("legacy"))
    return K.freeze_weeks(old, new)


@query("set_equality", "h_obs", "SELECT series_id, d, 'left' AS side FROM h_obs WHERE day(d) = 13")
def set_equality(spark, sf):
    obs = h_obs(spark, sf).select("series_id", "d")
    return T.same_set(obs, obs.where(F.dayofmonth("d") != 13))


@query("table_content_hash", "")
def table_content_hash(spark, sf):
    """Equal for equal rows in any order; the tests hold it against a shuffled copy."""
    return K.content_hash(table(spark, sf, "customer"))


@query("history_export", "h_signal", """
    SELECT d, verdict, CASE WHEN verdict <> 'NEUTRAL' THEN score END AS score FROM h_signal WHERE d BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""")
def history_export(spark, sf):
    rows = h_signal(spark, sf).where(F.col("d").between(F.lit("1996-01-01").cast("date"), F.lit("1998-12-31").cast("date")))
    return rows.select("d", "verdict", F.when(F.col("verdict") != "NEUTRAL", F.col("score")).alias("score"))


@query("latest_snapshots", "h_signal", "SELECT idx, d, score FROM (SELECT * FROM h_signal ORDER BY d DESC LIMIT 12)")
def latest_snapshots(spark, sf):
    """The last 12 snapshots: the limit is the feature."""
    return h_signal(spark, sf).orderBy(F.col("d").desc()).limit(12).select("idx", "d", "score")


@query("parameters", "")
def parameters(spark, sf):
    """The fixed parameters' digest."""
    return spark.createDataFrame([(P.digest(), len(P.SERIES))], "digest string, n_series long")
