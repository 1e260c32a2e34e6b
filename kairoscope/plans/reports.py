"""Queries: the robustness report in one row, and redacted log fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..functions.redaction import redact_json
from ..operators import stats as X
from .evaluation import SPEARMAN
from .flows import bootstrap_ic, robustness_report, sharpe_bootstrap, sharpe_sql
from .harness import ORACLES, h_pairs, query, r6, table, with_
from .research import stride_independent

#: Fewer rows than this have no bootstrap: bounds are the point itself, no resample is drawn.
LEAST = 20
#: Draws that the bootstrap of the IC takes; that of the Sharpe ratio goes on from there.
_DRAWN = "(SELECT 2000 * CAST(ceil(count(*) / 13) AS BIGINT) FROM h_pairs)"
_ALONE = f"SELECT n, ic FROM ({SPEARMAN.format(k='g', x='score', y='fwd', t='(SELECT 1 AS g, score, fwd FROM alone)', empty='0')})"


def _settled(point: str, n: str, prefix: str) -> str:
    few = f"{n} < {LEAST}"
    return (
        f"CASE WHEN {few} THEN {point} ELSE {prefix}.ci_low END AS {prefix}_ci_low, CASE WHEN {few} THEN {point} ELSE {prefix}.ci_high END AS {prefix}_ci_high, "
        f"CASE WHEN {few} THEN CASE WHEN {point} > 0 THEN 0 ELSE 1 END ELSE {prefix}.p_value END::DOUBLE AS {prefix}_p_value, CAST(CASE WHEN {few} THEN 0 ELSE {prefix}.iterations END AS BIGINT) AS {prefix}_iterations"
    )


@query("robustness_whole", "", f"""
    WITH alone AS ({ORACLES["stride_independent"]}), ai AS ({_ALONE}), r AS ({ORACLES["robustness_report"]}), bic AS ({ORACLES["bootstrap_ic"]}), bsh AS ({with_("h_price h_signal h_pairs", sharpe_sql(_DRAWN))}),
    s AS (SELECT min(o_orderdate)::DATE AS first_d, max(o_orderdate)::DATE AS last_d FROM orders)
    SELECT first_d, last_d, r.*, CAST(ai.n AS BIGINT) AS n_alone, ai.ic AS ic_alone, {_settled("r.ic", "r.n_pairs", "bic")}, bsh.ci_low AS bsh_ci_low, bsh.ci_high AS bsh_ci_high, bsh.p_value AS bsh_p_value, bsh.iterations AS bsh_iterations FROM s, r, ai, bic, bsh""")
def robustness_whole(spark, sf):
    """Window, ICs over all and over independent pairs, both bootstraps, returns, drawdown and turnover of the long-flat strategy."""
    orders = table(spark, sf, "orders").agg(F.to_date(F.min("o_orderdate")).alias("first_d"), F.to_date(F.max("o_orderdate")).alias("last_d"))
    report = robustness_report(spark, sf)
    alone = X.spearman(stride_independent(spark, sf).withColumn("g", F.lit(1)), "score", "fwd", ["g"]).select(F.col("n").alias("n_alone"), r6("ic", "ic_alone"))
    b = P.BOOTSTRAP
    drawn = b["iterations"] * -(-h_pairs(spark, sf).count() // b["block"])
    stats = (("bic", bootstrap_ic(spark, sf)), ("bsh", sharpe_bootstrap(spark, sf, drawn)))
    boots = [boot.select(*[F.col(c).alias(f"{p}_{c}") for c in ("ci_low", "ci_high", "p_value", "iterations")]) for p, boot in stats]
    out = orders
    for part in (report, alone, *boots):
        out = out.crossJoin(F.broadcast(part))  # one row each
    few = F.col("n_pairs") < LEAST
    settled = {
        "bic_ci_low": F.col("ic"), "bic_ci_high": F.col("ic"), "bic_p_value": F.when(F.col("ic") > 0, 0.0).otherwise(1.0), "bic_iterations": F.lit(0).cast("long"),
    }
    for name, point in settled.items():
        out = out.withColumn(name, F.when(few, point).otherwise(F.col(name)))
    return out


@query("redacted_fields", "", """
    SELECT event_id, '{"event":"' || event_type || '","access_token":"[REDACTED]","note":"password=[REDACTED] ok","apiKey":"[REDACTED]","n":' || CAST(user_id AS VARCHAR) || ',"none":null,"list":[' || array_to_string(range(least(32, 20 + event_id % 30)), ',')
        || '],"deep":{"a":{"b":{"c":"[TRUNCATED]"}}},"text":"' || repeat('x', CAST(least(512, 400 + event_id % 200) AS INTEGER)) || '"}' AS shown FROM events""")
def redacted_fields(spark, sf):
    """Nested log fields of each event: secrets masked, and text, depth and items bounded."""
    e = table(spark, sf, "events")
    fields = F.concat(
        F.lit('{"event":"'), "event_type", F.lit('","access_token":"t-'), F.col("user_id").cast("string"), F.lit('","note":"password='), "event_type", F.lit(' ok","apiKey":{"a":1},"n":'), F.col("user_id").cast("string"),
        F.lit(',"none":null,"list":['), F.array_join(F.sequence(F.lit(0).cast("long"), 19 + F.col("event_id") % 30).cast("array<string>"), ","), F.lit('],"deep":{"a":{"b":{"c":{"d":{"e":1}}}}},"text":"'),
        F.repeat(F.lit("x"), (400 + F.col("event_id") % 200).cast("int")), F.lit('"}'),
    )
    return e.select("event_id", redact_json(fields).alias("shown"))
