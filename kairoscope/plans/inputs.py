"""Queries: gates of raw histories, stored decisions and hypothesis ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import params as P
from ..operators import gates as G
from ..sources import readers as R
from .harness import NEEDS, REL, h_obs, h_price, h_signal, h_week, query, table
from .snapshot import _status

# ---------------------------------------------------------------- the raw and smooth history

#: Four series for each book; some books lack a week or a row, are off by a day, or hold a value that is none.
REL["h_books"] = """
    SELECT series_id AS book, 'WALCL' AS series_id, w + CASE WHEN series_id = '5-LOW' AND w < DATE '1996-06-01' THEN 3 ELSE 2 END AS d, v FROM h_week WHERE NOT (series_id = '3-MEDIUM' AND w BETWEEN DATE '1998-08-03' AND DATE '1998-08-17')
    UNION ALL SELECT series_id, 'WDTGAL', w + CASE WHEN series_id = '5-LOW' AND w < DATE '1996-06-01' THEN 3 ELSE 2 END, v FROM h_week WHERE NOT (series_id = '2-HIGH' AND w BETWEEN DATE '1999-03-01' AND DATE '1999-03-07')
    UNION ALL SELECT series_id, 'WTREGEN', d, v FROM h_obs
    UNION ALL SELECT book, 'RRPONTSYD', d, CASE WHEN book = '1-URGENT' AND d BETWEEN DATE '2000-06-01' AND DATE '2000-06-03' THEN 'nan'::DOUBLE ELSE close END
        FROM h_price CROSS JOIN (SELECT DISTINCT series_id AS book FROM h_week) WHERE NOT (book = '4-NOT SPECIFIED' AND d BETWEEN DATE '1999-06-01' AND DATE '1999-06-20')"""
NEEDS["h_books"] = ["h_obs", "h_week", "h_price"]


def h_books(spark, sf) -> DataFrame:
    day = lambda x: F.lit(x).cast("date")
    week = h_week(spark, sf).select(F.col("series_id").alias("book"), "w", "v")
    off = F.when((F.col("book") == "5-LOW") & (F.col("w") < day("1996-06-01")), 3).otherwise(2)
    named = lambda rows, s: rows.select("book", F.lit(s).alias("series_id"), F.date_add("w", off).alias("d"), "v")
    lacks = lambda book, a, b, on="w": (F.col("book") == book) & F.col(on).between(day(a), day(b))
    out = named(week.where(~lacks("3-MEDIUM", "1998-08-03", "1998-08-17")), "WALCL").unionByName(named(week.where(~lacks("2-HIGH", "1999-03-01", "1999-03-07")), "WDTGAL"))
    out = out.unionByName(h_obs(spark, sf).select(F.col("series_id").alias("book"), F.lit("WTREGEN").alias("series_id"), "d", "v"))
    repo = h_price(spark, sf).crossJoin(F.broadcast(week.select("book").distinct())).where(~lacks("4-NOT SPECIFIED", "1999-06-01", "1999-06-20", "d"))
    value = F.when(lacks("1-URGENT", "2000-06-01", "2000-06-03", "d"), F.lit(float("nan"))).otherwise(F.col("close"))
    return out.unionByName(repo.select("book", F.lit("RRPONTSYD").alias("series_id"), "d", value.alias("v")))


def _fits(s: str, found: str, at: str) -> str:
    calendar, business, fallback = P.SERIES[s][2], P.SERIES[s][3], P.SERIES[s][6]
    return f"(({_status(found, at, calendar, business, chr(39) + fallback + chr(39))}) = 'FRESH')"


#: The gate ``gt`` (book, d, n_anchors, reason) of decisions ``dec`` (book, d) over series ``bk`` (book, series_id, d, v).
GATE = f"""
    wr AS (SELECT DISTINCT book, d FROM (SELECT book, series_id, d FROM bk WHERE series_id IN ('WALCL', 'WDTGAL', 'WTREGEN', 'RRPONTSYD') GROUP BY ALL HAVING count(*) > 1 OR NOT bool_and(isfinite(v)))),
    rp AS (SELECT book, d, count(*) OVER f = 5 AND min(gap) OVER g >= 1 AND max(gap) OVER g <= 4 AS regular, lag(d, 4) OVER (PARTITION BY book ORDER BY d) AS fifth FROM (SELECT book, d, d - lag(d) OVER (PARTITION BY book ORDER BY d) AS gap FROM bk WHERE series_id = 'RRPONTSYD')
        WINDOW f AS (PARTITION BY book ORDER BY d ROWS 4 PRECEDING), g AS (PARTITION BY book ORDER BY d ROWS 3 PRECEDING)),
    an AS (SELECT a.book, a.d, x.d IS NOT NULL AS exact, t.d AS td, coalesce({_fits("WTREGEN", "t.d", "a.d")} AND a.d - t.d <= 6, false) AS average, coalesce({_fits("RRPONTSYD", "r.d", "a.d")} AND r.regular, false) AS repo, r.fifth
        FROM (SELECT book, d FROM bk WHERE series_id = 'WALCL') a LEFT JOIN (SELECT DISTINCT book, d FROM bk WHERE series_id = 'WDTGAL') x ON x.book = a.book AND x.d = a.d
        ASOF LEFT JOIN (SELECT book, d FROM bk WHERE series_id = 'WTREGEN') t ON t.book = a.book AND a.d >= t.d ASOF LEFT JOIN rp r ON r.book = a.book AND a.d >= r.d),
    ag AS (SELECT *, d - lag(d) OVER (PARTITION BY book ORDER BY d) AS gap, td - lag(td) OVER (PARTITION BY book ORDER BY d) AS tgap FROM an),
    af AS (SELECT book, d, count(*) OVER h AS n, min(gap) OVER g >= 5 AND max(gap) OVER g <= 10 AS cadence, bool_and(isodow(d) = 3) OVER h AS wed, bool_and(exact) OVER h AS exact, bool_and(average) OVER h AS average,
        bool_and(repo) OVER h AND coalesce(min(d) OVER h - first_value(fifth) OVER h <= 16, false) AS repo, min(tgap) OVER g >= 5 AND max(tgap) OVER g <= 10 AS tcadence
        FROM ag WINDOW h AS (PARTITION BY book ORDER BY d ROWS 169 PRECEDING), g AS (PARTITION BY book ORDER BY d ROWS 168 PRECEDING)),
    gt AS (SELECT dec.book, dec.d, CAST(coalesce(n, 0) AS BIGINT) AS n_anchors, CASE WHEN wr.d IS NOT NULL THEN 'INVALID_SERIES' WHEN coalesce(n, 0) < 66 THEN 'TOO_FEW_ANCHORS' WHEN NOT cadence THEN 'ANCHOR_CADENCE' WHEN NOT wed THEN 'ANCHOR_WEEKDAY'
        WHEN NOT {_fits("WALCL", "af.d", "dec.d")} THEN 'STALE_ANCHOR' WHEN NOT exact THEN 'TREASURY_DATE_MISSING' WHEN NOT average THEN 'TREASURY_AVERAGE_STALE' WHEN NOT repo THEN 'REPO_WINDOW' WHEN NOT tcadence THEN 'TREASURY_AVERAGE_CADENCE' END AS reason
        FROM dec ASOF LEFT JOIN wr ON wr.book = dec.book AND dec.d >= wr.d ASOF LEFT JOIN af ON af.book = dec.book AND dec.d - 7 >= af.d)"""


@query("raw_smooth_gate", "h_books h_week", f"WITH dec AS (SELECT series_id AS book, w + k AS d FROM h_week, (VALUES (4), (6)) t(k)), bk AS (SELECT * FROM h_books), {GATE} SELECT * FROM gt")
def raw_smooth_gate(spark, sf):
    """Each weekly decision of each book: whether its history of four series can be used, and if not, why."""
    decisions = h_week(spark, sf).select(F.col("series_id").alias("book"), F.explode(F.array(F.date_add("w", 4), F.date_add("w", 6))).alias("d"))
    return G.raw_smooth_gate(decisions, h_books(spark, sf), ["book"])


# ---------------------------------------------------------------- stored decisions

#: What a row's payload may have wrong, by field.
FLAWS = {
    "date": '"1997-02-30"', "decision_at": '"1997-01-01 22:00"', "recorded_at": "17", "data_cutoff": "null", "created_at": '"later"', "score": '"55"', "verdict": '"UP"', "vix_eod": "-1",
    "qe_qt_regime": '"SIDEWAYS"', "model_version": '"LEGACY_UNVERSIONED"', "config_hash": '"abc"', "code_commit_sha": '"HEAD"', "data_run_id": '""', "clock_order": "", "factors_json": '"[1]"', "factor_quality_json": '"{"',
}
_ISSUE_OF = {"verdict": "policy", "vix_eod": "policy"}


def stored_decisions(spark, sf) -> DataFrame:
    """idx and payload: each signal as the JSON text of a stored decision, every third one with a flaw in one field, some broken."""
    i = F.col("idx")
    flaw = F.when(i % 3 == 1, F.element_at(F.array(*[F.lit(f) for f in FLAWS]), (i % len(FLAWS) + 1).cast("int")))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    clock = lambda days, hour: quoted(F.date_format(F.date_add("d", days).cast("timestamp") + F.expr(f"INTERVAL {hour} HOURS"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    fields = {
        "date": quoted(F.col("d").cast("string")), "decision_at": clock(0, 22), "recorded_at": F.when(flaw == "clock_order", clock(-1, 5)).otherwise(clock(0, 23)), "data_cutoff": clock(0, 21),
        "created_at": clock(1, 1), "score": F.floor("score").cast("string"), "verdict": quoted(F.col("verdict")), "netliq_dir": F.lit('"UP"'), "vix_eod": F.when(i % 3 == 0, "null").otherwise("18.5"),
        "qe_qt_regime": F.lit('"FLAT"'), "model_version": F.lit('"m-1"'), "config_hash": quoted(F.repeat(F.lit("ab"), 32)),
        "code_commit_sha": F.when(i % 2 == 0, '"LOCAL_UNCONFIGURED"').otherwise(quoted(F.repeat(F.lit("0f"), 20))), "data_run_id": quoted(F.concat(F.lit("run-"), i.cast("string"))),
        "factors_json": F.lit('"{}"'), "factor_quality_json": F.lit('"{}"'),
    }
    told = [F.concat(F.lit(f'"{f}":'), F.when(flaw == f, FLAWS[f]).otherwise(x) if f in FLAWS else x) for f, x in fields.items()]
    text = F.concat(F.lit("{"), F.concat_ws(",", *told), F.lit("}"))
    return h_signal(spark, sf).select("idx", F.when(i % 50 == 49, "{broken").otherwise(text).alias("payload"))


_NAMES = ", ".join(f"'{f}'" for f in FLAWS)


@query("decision_rows", "h_signal", f"""
    WITH f AS (SELECT *, CASE WHEN idx % 3 = 1 THEN [{_NAMES}][idx % {len(FLAWS)} + 1] END AS flaw FROM h_signal)
    SELECT idx, CASE WHEN idx % 50 = 49 THEN 'INVALID_JSON' WHEN flaw IN ({", ".join(f"'{f}'" for f in _ISSUE_OF)}) THEN 'policy' WHEN flaw IS NOT NULL THEN flaw WHEN d + 1 >= DATE '2001-07-01' THEN 'clock_order' END AS issue,
        CASE WHEN idx % 50 <> 49 AND NOT coalesce(flaw = 'score', false) THEN floor(score)::DOUBLE END AS score FROM f""")
def decision_rows(spark, sf):
    """Stored decisions as JSON text, parsed by type and clock order; each field can refuse its row."""
    got = R.decision_rows(stored_decisions(spark, sf), F.lit("2001-07-02").cast("timestamp"))
    return got.select("idx", "issue", "row.score")


# ---------------------------------------------------------------- ledgers


@query("ledger_issues", "", """
    WITH e AS (SELECT o_custkey AS ledger, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place, o_orderkey, CASE WHEN o_orderkey % 41 = 0 THEN o_orderpriority ELSE CAST(o_orderkey AS VARCHAR) END AS id FROM orders),
    s AS (SELECT *, CASE WHEN o_orderkey % 37 = 3 THEN lead(id) OVER w WHEN o_orderkey % 31 = 5 THEN 'H-0' WHEN o_orderkey % 29 = 7 THEN id WHEN o_orderkey % 3 = 0 THEN lag(id, 2) OVER w END AS supersedes, o_orderkey % 43 AS directions FROM e WINDOW w AS (PARTITION BY ledger ORDER BY place)),
    n AS (SELECT *, row_number() OVER (PARTITION BY ledger, id ORDER BY place) AS k FROM s), f AS (SELECT ledger, id, place FROM n WHERE k = 1)
    SELECT n.ledger, CAST(n.place AS BIGINT) AS place, n.id, n.supersedes, CASE WHEN k > 1 THEN 'REPEATED_ID' WHEN directions < 1 THEN 'INVALID_COUNT' WHEN n.supersedes IS NOT NULL AND f.id IS NULL THEN 'UNKNOWN_REFERENCE'
        WHEN f.place = n.place THEN 'REFERS_TO_ITSELF' WHEN f.place > n.place THEN 'FORWARD_REFERENCE' END AS issue FROM n LEFT JOIN f ON f.ledger = n.ledger AND f.id = n.supersedes""")
def ledger_issues(spark, sf):
    """Each customer's orders as a ledger of hypotheses: ids stand once and supersede earlier ones only."""
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("ledger"), "o_orderkey", "o_orderdate", F.when(k % 41 == 0, F.col("o_orderpriority")).otherwise(k.cast("string")).alias("id"))
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("ledger").orderBy("o_orderdate", "o_orderkey")).cast("long"))
    w = W.partitionBy("ledger").orderBy("place")
    refers = F.when(k % 37 == 3, F.lead("id").over(w)).when(k % 31 == 5, "H-0").when(k % 29 == 7, F.col("id")).when(k % 3 == 0, F.lag("id", 2).over(w))
    rows = rows.select("ledger", "place", "id", refers.alias("supersedes"), (k % 43).alias("directions"), F.lit(1).alias("windows"), F.lit(1).alias("parameters"))
    return G.ledger_issues(rows, ["ledger"]).select("ledger", "place", "id", "supersedes", "issue")
