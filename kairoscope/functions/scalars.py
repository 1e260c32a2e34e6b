"""Scalar column expressions. All stay in the JVM and propagate nulls unless they say otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def clamp(x, low: float = 0.0, high: float = 100.0) -> Column:
    """``x`` held between two bounds; null stays null."""
    x = _c(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def lin_map(x, a: float, b: float) -> Column:
    """0 at ``a``, 100 at ``b``, held there; ``a`` may be above ``b``."""
    return clamp((_c(x) - F.lit(float(a))) / F.lit(float(b - a)) * 100.0)


def finite(x) -> Column:
    """NaN, infinities and null become 0."""
    x = _c(x)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def safe_div(a, b) -> Column:
    """Null where the divisor is 0."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def ieee_div(a, b) -> Column:
    """As DuckDB divides doubles: by 0 to an infinity, and 0 by 0 to NaN."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(a * F.pow(b, F.lit(-1.0)))


def ratio_change(now, before) -> Column:
    return safe_div(_c(now), _c(before)) - 1.0


def js_number(x) -> Column:
    """A double as text without a trailing ``.0``."""
    x = _c(x)
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))


def checksum(*parts: Column) -> Column:
    """SHA-256 of parts joined by ``|``."""
    return F.sha2(F.concat_ws("|", *parts), 256)


# ---------------------------------------------------------------- dates


def strict_date(text) -> Column:
    """A date only if the text is its canonical form."""
    text = _c(text)
    d = F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")
    return F.when(F.date_format(d, "yyyy-MM-dd") == text, d)


def strict_instant(text) -> Column:
    """A UTC instant only if the text is canonical, with or without milliseconds."""
    text = _c(text)
    good = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?Z$")
    at = F.try_to_timestamp(F.when(good, text))
    long_, short = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when((text == long_) | (text == short), at)


def loose_date(text) -> Column:
    """``YYYY-MM-DD``, ``YYYY-MM`` (its first day) or ``M/D/YYYY``; else null."""
    text = _c(text)
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    month = F.when(text.rlike(r"^\d{4}-\d{2}$"), F.try_to_timestamp(F.concat(text, F.lit("-01")), F.lit("yyyy-MM-dd")))
    us = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(text, F.lit("M/d/yyyy")))
    return F.coalesce(iso, month, us).cast("date")


def monday(d) -> Column:
    return F.date_trunc("week", _c(d)).cast("date")


def business_days(start, end) -> Column:
    """Weekdays in (start, end], in closed form; 0 if end is not after start."""
    # weekdays from day 0 of the week of the epoch (a Monday at -3) up to a day
    def upto(d: Column) -> Column:
        n = F.unix_date(d) + 3
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(4)) + 1

    start, end = _c(start), _c(end)
    return F.when(end > start, upto(end) - upto(start)).otherwise(F.when(end.isNotNull() & start.isNotNull(), 0)).cast("long")


def next_weekday(d) -> Column:
    """The first weekday after a date."""
    d = _c(d)
    return F.date_add(d, F.when(F.weekday(d) == 4, 3).when(F.weekday(d) == 5, 2).otherwise(1))


def at_time(d, clock: str) -> Column:
    """The instant of a date at a UTC clock time HH:MM:SS."""
    h, m, s = map(int, clock.split(":"))
    return (_c(d).cast("timestamp").cast("long") + F.lit(h * 3600 + m * 60 + s)).cast("timestamp")


def year_fraction(start, end) -> Column:
    return F.datediff(_c(end), _c(start)) / F.lit(365.25)


# ---------------------------------------------------------------- normal distribution

# Coefficients of the rational approximation of the inverse normal
# distribution (central and tail region), and of the error function.
PROBIT_A = (-39.6968302866538, 220.946098424521, -275.928510446969, 138.357751867269, -30.6647980661472, 2.50662827745924)
PROBIT_B = (-54.4760987982241, 161.585836858041, -155.698979859887, 66.8013118877197, -13.2806815528857)
PROBIT_C = (-0.00778489400243029, -0.322396458041136, -2.40075827716184, -2.54973253934373, 4.37466414146497, 2.93816398269878)
PROBIT_D = (0.00778469570904146, 0.32246712907004, 2.445134137143, 3.75440866190742)
PROBIT_TAIL = 0.02425
ERF_P, ERF = 0.3275911, (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592)


def horner(x: Column, coefficients: tuple[float, ...], last: float | None = None) -> Column:
    out = F.lit(coefficients[0])
    for k in [*coefficients[1:], *([last] if last is not None else [])]:
        out = out * x + F.lit(k)
    return out


def probit(p) -> Column:
    """Inverse of the normal distribution function; null outside (0, 1)."""
    p = _c(p)
    low = F.least(p, 1.0 - p)
    tail = F.sqrt(F.log(F.when(low > 0, low)) * -2.0)
    outer = horner(tail, PROBIT_C) / horner(tail, PROBIT_D, 1.0)
    q = p - 0.5
    inner = horner(q * q, PROBIT_A) * q / horner(q * q, PROBIT_B, 1.0)
    return F.when((p <= 0) | (p >= 1), None).when(p < PROBIT_TAIL, outer).when(p > 1 - PROBIT_TAIL, -outer).otherwise(inner)


def normal_cdf(x) -> Column:
    x = _c(x)
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (z * ERF_P + 1.0)
    erf = F.lit(1.0) - horner(t, ERF) * t * F.exp(-z * z)
    return F.when(x < 0, (F.lit(1.0) - erf) * 0.5).otherwise((erf + 1.0) * 0.5)


# ---------------------------------------------------------------- text


def csv_cell(x) -> Column:
    """A CSV cell: null empty, formula starts disarmed by a quote mark, quoted where needed."""
    x = F.coalesce(_c(x).cast("string"), F.lit(""))
    safe = F.when(x.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), x)).otherwise(x)
    return F.when(safe.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.regexp_replace(safe, '"', '""'), F.lit('"'))).otherwise(safe)


# What a log must not show.
SECRET = r"""(?i)(["']?(?:authorization|access[_-]?token|refresh[_-]?token|token|api[_-]?key|password|secret)["']?\s*[:=]\s*["']?)(?:Bearer\s+)?([^"'\s,;}&]+)"""
BEARER = r"""(?i)\bBearer\s+[^"'\s,;}&]+"""


def redact(x, longest: int = 512) -> Column:
    """Text with the values of secret keys and bearer tokens masked, cut to a length."""
    x = F.regexp_replace(_c(x), F.lit(SECRET), F.lit("$1[REDACTED]"))
    return F.substring(F.regexp_replace(x, F.lit(BEARER), F.lit("Bearer [REDACTED]")), 1, longest)


def release_timing(vintage, fetched, release_time, override_released=None, override_tradable=None) -> Column:
    """struct(released_at, tradable_at, status): an override wins; a fetch on the vintage's
    own day is the release; else the rule's time on that day."""
    v, f = _c(vintage), _c(fetched)
    same = f.cast("date") == v
    ruled = F.to_timestamp(F.concat(v.cast("string"), F.lit(" "), _c(release_time)))
    released = F.when(same, f).otherwise(ruled)
    status = F.when(same, "OBSERVED_AT_FETCH").otherwise("CONSERVATIVE_DATE_END")
    tradable = at_time(next_weekday(released.cast("date")), "14:30:00")
    if override_released is not None:
        o = _c(override_released)
        status = F.when(o.isNotNull(), "OVERRIDE").otherwise(status)
        tradable = F.when(o.isNotNull(), _c(override_tradable)).otherwise(tradable)
        released = F.coalesce(o, released)
    return F.struct(released.alias("released_at"), tradable.alias("tradable_at"), status.alias("status"))
