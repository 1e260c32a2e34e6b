"""Statistics with typed statuses, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import params as P
from ..functions.scalars import _c, normal_cdf, probit
from .windows import average_rank


def typed(n: Column, value: Column, status: Column) -> Column:
    return F.struct(F.when(status == "OK", value).alias("value"), n.cast("long").alias("n"), status.alias("status"))


def correlation(x, y, default: float | None = 0.0, least: int = 3) -> Column:
    """Pearson correlation; ``default`` for under ``least`` pairs or a side without spread.

    Built from moments: a correlation of a constant raises an error.
    """
    x, y = _c(x), _c(y)
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    both = lambda e: F.when(x.isNotNull() & y.isNotNull(), e)
    spread = F.var_pop(both(x)) * F.var_pop(both(y))
    good = (n >= least) & (F.min(both(x)) < F.max(both(x))) & (F.min(both(y)) < F.max(both(y)))
    r = F.covar_pop(both(x), both(y)) / F.sqrt(F.when(good & (spread > 0), spread))
    return F.when(good & (spread > 0), r).otherwise(F.lit(default).cast("double"))


def with_ranks(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    return df.withColumn("__rx", average_rank(x, keys)).withColumn("__ry", average_rank(y, keys))


def spearman(df: DataFrame, x: str, y: str, keys: list[str], default: float | None = 0.0, name="ic", *more: Column) -> DataFrame:
    """Correlation of the average ranks in each group."""
    ranked = with_ranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, y, keys)
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), correlation("__rx", "__ry", default).alias(name), *more)


def ic_status(n: Column, distinct_x: Column, distinct_y: Column) -> Column:
    return F.when(n < P.MIN_IC, "INSUFFICIENT_SAMPLE").when((distinct_x < 2) | (distinct_y < 2), "ZERO_VARIANCE").otherwise("OK")


def rate(hits: Column, n: Column) -> Column:
    """Typed share: nothing eligible, too few (under 5), or OK."""
    status = F.when(n == 0, "NO_ELIGIBLE_OBSERVATIONS").when(n < P.MIN_RATE, "INSUFFICIENT_SAMPLE").otherwise("OK")
    return typed(n, F.try_divide(hits.cast("double"), n), status)


def hit_rate(score, fwd) -> Column:
    """Share of pairs with score >= 50 exactly when the return is >= 0; 0 without pairs."""
    return F.coalesce(F.avg(((_c(score) >= 50) == (_c(fwd) >= 0)).cast("double")), F.lit(0.0))


def direction_rate(score, fwd) -> Column:
    """Pairs with score 50 or return 0 abstain."""
    votes = (_c(score) != 50) & (_c(fwd) != 0)
    hit = votes & ((_c(score) > 50) == (_c(fwd) > 0))
    return rate(F.count_if(hit), F.count_if(votes))


def verdict_rate(verdict, fwd) -> Column:
    """Neutral verdicts and zero returns abstain; a missing verdict voids the value."""
    v = _c(verdict)
    votes = v.isin("BULLISH", "BEARISH") & (_c(fwd) != 0)
    hit = votes & ((v == "BULLISH") == (_c(fwd) > 0))
    n = F.count_if(votes)
    status = (
        F.when(F.count_if(v.isNull()) > 0, "MISSING_FORMAL_SIGNAL").when(n == 0, "NO_ELIGIBLE_OBSERVATIONS")
        .when(n < P.MIN_RATE, "INSUFFICIENT_SAMPLE").otherwise("OK")
    )
    return typed(n, F.try_divide(F.count_if(hit).cast("double"), n), status)


def risk_rates(target, fwd) -> tuple[Column, Column]:
    """Precision and recall of calls (exposure at most 0.5) against negative returns."""
    call, fell = _c(target) <= 0.5, _c(fwd) < 0
    return rate(F.count_if(call & fell), F.count_if(call)), rate(F.count_if(call & fell), F.count_if(fell))


def tail_rates(target, fwd, threshold) -> tuple[Column, Column]:
    """As risk rates, against returns at or under a threshold; at least three of each."""
    call, fell = _c(target) <= 0.5, _c(fwd) <= _c(threshold)
    hits, calls, events = F.count_if(call & fell), F.count_if(call), F.count_if(fell)
    status = F.when((events < P.MIN_TAIL_EVENTS) | (calls < P.MIN_TAIL_EVENTS), "INSUFFICIENT_SAMPLE").otherwise("OK")
    return typed(calls, F.try_divide(hits.cast("double"), calls), status), typed(events, F.try_divide(hits.cast("double"), events), status)


def quintile(df: DataFrame, order: list[str], keys: list[str], name="quintile") -> DataFrame:
    """Slices floor(i n / 5) of the ordered rows: ceil(5 rn / n), not ntile."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    return df.withColumn(name, F.ceil(rn * F.lit(5) / n).cast("long"))


def bucket(score) -> Column:
    """Index from 0 of the score's bucket; left-closed, the last one closed; null outside."""
    s, cuts = _c(score), P.BUCKETS
    out = F.when(s == cuts[-1], len(cuts) - 2)
    for k in range(len(cuts) - 1):
        out = out.when((s >= cuts[k]) & (s < cuts[k + 1]), k)
    return out.cast("long")


def benjamini_hochberg(df: DataFrame, family="family", ident="hypothesis_id", p="p_value") -> DataFrame:
    """Adds effective_p, rank, family_size, adjusted_p, rejected. A missing p counts as 1; ties go by id, missing ids last."""
    out = df.withColumn("effective_p", F.coalesce(p, F.lit(1.0)))
    w = W.partitionBy(family).orderBy("effective_p", F.asc_nulls_last(ident))
    out = out.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("family_size", F.count(F.lit(1)).over(W.partitionBy(family)))
    raw = F.col("effective_p") * F.col("family_size") / F.col("rank")
    # from the last rank to the first: a frame of all rows that follow is read anew for each row
    least = F.min(raw).over(W.partitionBy(family).orderBy(F.desc("rank")).rowsBetween(W.unboundedPreceding, W.currentRow))
    return out.withColumn("adjusted_p", F.least(F.lit(1.0), least)).withColumn("rejected", F.col("adjusted_p") <= P.BH_ALPHA)


def deflated_sharpe(observed, variance, trials, sample, skew, kurtosis) -> Column:
    """Deflated Sharpe ratio; null where it is not defined."""
    gamma, e = 0.5772156649015329, 2.718281828459045
    n = _c(trials)
    # each value is bound once: the approximations name their argument many times
    bound = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    expected = F.sqrt(_c(variance)) * (bound(1.0 - 1.0 / n, probit) * (1 - gamma) + bound(1.0 - 1.0 / (n * e), probit) * gamma)
    under = F.lit(1.0) - _c(skew) * _c(observed) + (_c(kurtosis) - 1.0) / 4.0 * _c(observed) * _c(observed)
    stat = (_c(observed) - expected) * F.sqrt(_c(sample) - 1.0) / F.sqrt(F.when(under > 0, under))
    return F.when((n >= 2) & (_c(sample) >= 2) & (_c(variance) > 2.220446049250313e-16), bound(stat, normal_cdf))


def ic_weights(ics: DataFrame, keys: list[str], factor="factor", ic="ic", n="n") -> DataFrame:
    """max(0, IC) normalised in each group; equal over factors with three pairs if none is positive."""
    eligible = F.col(n) >= P.MIN_IC
    good = F.when(eligible, F.greatest(F.col(ic), F.lit(0.0))).otherwise(0.0)
    w = W.partitionBy(*keys)
    total, count = F.sum(good).over(w), F.sum(eligible.cast("int")).over(w)
    equal = F.when(eligible, F.try_divide(F.lit(1.0), count)).otherwise(0.0)
    return ics.withColumn("weight", F.when(total > 0, good / F.when(total > 0, total)).otherwise(equal))
