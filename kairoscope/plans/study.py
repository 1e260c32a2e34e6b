"""Queries: candidate factors from raw rows to their verdicts, the candidate as a key all the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import params as P
from ..functions import scores as C
from ..operators import asof as A
from ..operators import sets as T
from ..operators import simulate as M
from ..operators import stats as X
from ..operators import windows as N
from .evaluation import SPEARMAN
from .flows import MULBERRY
from .harness import h_factor, h_obs, h_pairs, h_price, h_vix, query, r6

#: Candidates: their raw series, what of it is the signal, and the sign that a good one has.
CANDIDATES = [("urgent_level", "1-URGENT", "level", 1), ("high_change", "2-HIGH", "change", 1), ("medium_change", "3-MEDIUM", "change", -1), ("low_level", "5-LOW", "level", -1)]
#: Days that a signal may be old, days of its change, rows that a verdict takes.
SIGNAL_DAYS, CHANGE_DAYS = 45, 91
ERA = "1998-07-01"


def study_pairs(spark, sf) -> DataFrame:
    """candidate, sign, d, x (the signal as of the snapshot, if fresh), cand (its place in its own history, in percent), comp (mean of all factors), fwd, impulse, vix."""
    named = spark.createDataFrame(CANDIDATES, "candidate string, series_id string, kind string, sign int")
    raw = h_obs(spark, sf).join(F.broadcast(named), "series_id")
    old = A.asof_last(raw.withColumn("t", F.date_sub("d", CHANGE_DAYS)), raw.select("candidate", "d", "v"), keys=["candidate"], on="t", data_on="d", carry=["v"], prefix="o_")
    signal = old.withColumn("x", F.when(F.col("kind") == "level", F.col("v")).otherwise(F.try_divide(F.col("v"), F.col("o_v")) - 1)).where("x is not null").select("candidate", "d", "x")
    prices = h_price(spark, sf)
    weekly = h_pairs(spark, sf).select("d", "fwd", F.date_trunc("week", "d").cast("date").alias("w")).join(prices, "d")
    weekly = weekly.withColumn("impulse", C.impulse_label(F.col("close") / 1000, F.lag(F.col("close") / 1000, 13).over(W.orderBy("d")))).drop("close")  # a row a week
    weekly = weekly.join(h_factor(spark, sf).groupBy("w").agg(F.avg("f").alias("comp")), "w").join(h_vix(spark, sf).select("d", F.col("v").alias("vix")), "d", "left")
    rows = A.asof_last(weekly.crossJoin(F.broadcast(named.select("candidate", "sign"))), signal, keys=["candidate"], carry=["x"], prefix="s_")
    rows = rows.where(F.datediff("d", "s_date") <= SIGNAL_DAYS).withColumnRenamed("s_x", "x")
    rows = N.expanding_share(rows.select("candidate", "sign", "d", "x", "comp", "fwd", "impulse", "vix"), "x", ["candidate"], "d")
    return rows.withColumn("cand", F.when(F.col("sign") > 0, F.col("share") * 100).otherwise((1 - F.col("share")) * 100)).drop("share")


_NAMED = "cn(candidate, series_id, kind, sign) AS (VALUES " + ", ".join(f"('{c}', '{s}', '{k}', {g})" for c, s, k, g in CANDIDATES) + ")"
_PAIRS = f"""{_NAMED}, ra AS (SELECT candidate, kind, d, v FROM h_obs JOIN cn USING (series_id)),
    si AS (SELECT * FROM (SELECT a.candidate, a.d, CASE WHEN a.kind = 'level' THEN a.v ELSE a.v / nullif(b.v, 0) - 1 END AS x FROM ra a ASOF LEFT JOIN ra b ON a.candidate = b.candidate AND a.d - {CHANGE_DAYS} >= b.d) WHERE x IS NOT NULL),
    wk AS (SELECT p.d, p.fwd, CAST(date_trunc('week', p.d) AS DATE) AS w, close / 1000 - lag(close / 1000, 13) OVER (ORDER BY p.d) AS step FROM h_pairs p JOIN h_price USING (d)),
    co AS (SELECT w, avg(f) AS comp FROM h_factor GROUP BY 1),
    sn AS (SELECT cn.candidate, cn.sign, wk.d, wk.fwd, comp, CASE WHEN step > 50 THEN 'EXPANDING' WHEN step < -50 THEN 'CONTRACTING' ELSE 'FLAT' END AS impulse, v.v AS vix FROM wk JOIN co USING (w) LEFT JOIN h_vix v ON v.d = wk.d CROSS JOIN cn),
    pr AS (SELECT sn.*, si.x FROM sn ASOF JOIN si ON sn.candidate = si.candidate AND sn.d >= si.d WHERE sn.d - si.d <= {SIGNAL_DAYS}),
    sh AS (SELECT a.candidate, a.d, count(*) FILTER (b.x <= a.x) / count(*) AS share FROM pr a JOIN pr b ON a.candidate = b.candidate AND b.d <= a.d GROUP BY 1, 2),
    st AS (SELECT pr.*, CASE WHEN sign > 0 THEN share * 100 ELSE (1 - share) * 100 END AS cand, row_number() OVER (PARTITION BY candidate ORDER BY d) - 1 AS idx FROM pr JOIN sh USING (candidate, d))"""


def _ic(k: str, x: str, t: str, digits: int = 6) -> str:
    return SPEARMAN.format(k=k, x=x, y="fwd", t=t, empty="0").replace(", 6) AS ic", f", {digits}) AS ic")


_BOOT = f"""m AS (SELECT candidate, count(*) AS n, CAST(ceil(count(*) / 13) AS BIGINT) AS per FROM st GROUP BY 1), k AS (SELECT unnest(range((SELECT 2000 * max(per) FROM m))) AS k), {MULBERRY},
    bs AS (SELECT candidate, i AS iter, bb * 13 AS base, CAST(floor(u * n) AS BIGINT) AS start, n FROM (SELECT m.*, i, unnest(range(per)) AS bb FROM m, range(2000) t(i)) JOIN u ON u.k = i * per + bb),
    bp AS (SELECT candidate, iter, (start + o) % n AS idx FROM bs, range(13) r(o) WHERE base + o < n),
    br AS (SELECT candidate || '|' || iter AS g, x, fwd FROM bp JOIN st USING (candidate, idx)), bi AS ({_ic("g", "x", "br", 12)}),
    bo AS (SELECT split_part(g, '|', 1) AS candidate, round(quantile_cont(ic, 0.025), 6) AS ci_low, round(quantile_cont(ic, 0.975), 6) AS ci_high, round(avg(CASE WHEN ic <= 0 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS p_value FROM bi GROUP BY 1)"""
_ALONE = """od AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY d) AS r FROM st),
    gr AS (SELECT candidate, r, d, x, fwd FROM od WHERE r = 1 UNION ALL SELECT gr.candidate, n.r, n.d, n.x, n.fwd FROM gr, LATERAL (SELECT * FROM od WHERE od.candidate = gr.candidate AND od.r > gr.r AND od.d >= gr.d + 91 ORDER BY od.r LIMIT 1) n)"""


@query("candidate_study", "h_obs h_pairs h_factor h_vix", f"""WITH RECURSIVE {_PAIRS}, {_BOOT}, {_ALONE},
    al AS ({_ic("candidate", "x", "st")}), ai AS ({_ic("candidate", "x", "gr")}),
    in_ AS (SELECT candidate || '|base' AS g, round(comp, 9) AS x, fwd FROM st UNION ALL SELECT candidate || '|with', round((comp * 9 + cand) / 10, 9), fwd FROM st), ii AS ({_ic("g", "x", "in_")}),
    rk AS (SELECT candidate, fwd, rank() OVER (PARTITION BY candidate ORDER BY cand) + (count(*) OVER (PARTITION BY candidate, cand) - 1) / 2 AS rc, rank() OVER (PARTITION BY candidate ORDER BY comp) + (count(*) OVER (PARTITION BY candidate, comp) - 1) / 2 AS rb FROM st),
    fi AS (SELECT candidate, regr_slope(rc, rb) AS b, regr_intercept(rc, rb) AS a FROM rk GROUP BY 1), re AS (SELECT candidate, round(rc - a - b * rb, 6) AS x, fwd FROM rk JOIN fi USING (candidate)), ri AS ({_ic("candidate", "x", "re")}),
    al2 AS (SELECT st.candidate, any_value(sign) AS sign, min(d) AS first, max(d) AS last FROM st GROUP BY 1),
    z AS (SELECT al.candidate, sign, first, last, al.n, al.ic, ai.n AS independent_n, ai.ic AS independent_ic, ci_low, ci_high, p_value, wi.ic AS ic_with, ba.ic AS ic_base, round(wi.ic - ba.ic, 6) AS delta, ri.ic AS residual
        FROM al JOIN al2 USING (candidate) JOIN ai USING (candidate) JOIN bo USING (candidate) JOIN ii wi ON wi.g = al.candidate || '|with' JOIN ii ba ON ba.g = al.candidate || '|base' JOIN ri USING (candidate))
    SELECT * EXCLUDE (sign), CASE WHEN (CASE WHEN sign > 0 THEN ci_low ELSE -ci_high END > 0 OR (CASE WHEN sign > 0 THEN p_value ELSE 1 - p_value END < 0.1 AND sign * ic > 0)) AND (delta > 0.003 OR abs(residual) > 0.05) AND independent_n >= 10 THEN 'PASS'
        WHEN abs(ic) > 0.05 OR abs(residual) > 0.05 THEN 'DISPLAY-ONLY' ELSE 'DROP' END AS verdict FROM z""")
def candidate_study(spark, sf):
    """A row for each candidate: coverage, ICs over all and over independent pairs, bootstrap, increment, residual and the verdict."""
    pairs, b, key = study_pairs(spark, sf), P.BOOTSTRAP, ["candidate"]
    numbered = pairs.withColumn("idx", F.row_number().over(W.partitionBy("candidate").orderBy("d")) - 1).select("candidate", "idx", "x", "fwd")
    drawn = M.keyed_block_bootstrap(numbered, key, block=b["block"], iterations=b["iterations"], draw=lambda k: M.mulberry32(b["seed"], k))
    boot = X.spearman(drawn, "x", "fwd", ["candidate", "iter"]).groupBy("candidate").agg(
        r6(F.expr("percentile(ic, 0.025D)"), "ci_low"), r6(F.expr("percentile(ic, 0.975D)"), "ci_high"), r6(F.avg((F.col("ic") <= 0).cast("double")), "p_value")
    )
    ic = lambda rows, x, n, c: X.spearman(rows, x, "fwd", key).select("candidate", F.col("n").alias(n), r6("ic", c))
    alone = T.chronological_set(pairs.withColumn("until", F.date_add("d", P.EMBARGO_DAYS)).select("candidate", "d", "until", "x", "fwd"), key, "d", "until")
    both = pairs.withColumn("base", F.round("comp", 9)).withColumn("with", F.round((F.col("comp") * 9 + F.col("cand")) / 10, 9))
    ranked = pairs.withColumn("rc", N.average_rank("cand", key)).withColumn("rb", N.average_rank("comp", key))
    fit = ranked.groupBy("candidate").agg(F.expr("regr_slope(rc, rb)").alias("b"), F.expr("regr_intercept(rc, rb)").alias("a"))
    rest = ranked.join(fit, "candidate").withColumn("res", F.round(F.col("rc") - F.col("a") - F.col("b") * F.col("rb"), 6))
    out = pairs.groupBy("candidate", "sign").agg(F.min("d").alias("first"), F.max("d").alias("last"))
    for part in (ic(pairs, "x", "n", "ic"), ic(alone, "x", "independent_n", "independent_ic"), boot, ic(both, "with", "__n", "ic_with").drop("__n"), ic(both, "base", "__n", "ic_base").drop("__n"), ic(rest, "res", "__n", "residual").drop("__n")):
        out = out.join(part, "candidate")
    out = out.withColumn("delta", F.round(F.col("ic_with") - F.col("ic_base"), 6))
    verdict = lambda sign: C.candidate_verdict("ic", "ci_low", "ci_high", "p_value", "delta", "residual", "independent_n", sign)
    return out.withColumn("verdict", F.when(F.col("sign") > 0, verdict(1)).otherwise(verdict(-1))).drop("sign")


@query("candidate_regimes", "h_obs h_pairs h_factor h_vix", f"""WITH {_PAIRS},
    md AS (SELECT quantile_disc(vix, 0.5) AS md FROM (SELECT DISTINCT d, vix FROM st) WHERE vix IS NOT NULL),
    lb AS (SELECT candidate || '|' || axis || '|' || label AS g, x, fwd FROM st, md, LATERAL (VALUES ('balance_sheet', impulse), ('era', CASE WHEN d < DATE '{ERA}' THEN 'pre' ELSE 'post' END), ('vix', CASE WHEN vix < md THEN 'low' WHEN vix IS NOT NULL THEN 'high' END)) v(axis, label) WHERE label IS NOT NULL),
    i AS ({_ic("g", "x", "lb")}) SELECT split_part(g, '|', 1) AS candidate, split_part(g, '|', 2) AS axis, split_part(g, '|', 3) AS label, n, ic FROM i""")
def candidate_regimes(spark, sf):
    """ICs of each candidate by balance sheet, era and volatility."""
    pairs = study_pairs(spark, sf)
    middle = pairs.select("d", "vix").distinct().agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY vix)").alias("middle"))
    era = F.when(F.col("d") < F.lit(ERA).cast("date"), "pre").otherwise("post")
    calm = F.when(F.col("vix") < F.col("middle"), "low").when(F.col("vix").isNotNull(), "high")
    axes = F.array(*[F.struct(F.lit(n).alias("axis"), c.alias("label")) for n, c in (("balance_sheet", F.col("impulse")), ("era", era), ("vix", calm))])
    rows = pairs.crossJoin(F.broadcast(middle)).select("candidate", "x", "fwd", F.explode(axes).alias("a")).select("candidate", "x", "fwd", "a.*").where("label is not null")
    return X.spearman(rows, "x", "fwd", ["candidate", "axis", "label"]).select("candidate", "axis", "label", "n", r6("ic", "ic"))
