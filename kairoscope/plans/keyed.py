"""Queries: keyed state from a whole table; the streams of ``streaming.stateful`` give the same rows."""

from __future__ import annotations

from ..streaming import stateful as S
from .harness import query, table

LIMIT, SECONDS = 3, 6 * 3600


@query("judged_events", "", """
    WITH b AS (SELECT user_id, event_id, ts, coalesce(last_value(CASE WHEN value > 55 THEN 'BULLISH' WHEN value < 45 THEN 'BEARISH' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 'NEUTRAL') AS verdict FROM events),
    e AS (SELECT *, CASE verdict WHEN 'BULLISH' THEN 1.0 WHEN 'NEUTRAL' THEN 0.75 ELSE 0.25 END::DOUBLE AS new_exposure FROM b)
    SELECT user_id, event_id, ts, verdict, lag(new_exposure, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, event_id)::DOUBLE AS old_exposure, new_exposure FROM e""")
def judged_events(spark, sf):
    """Each user's values as scores: verdicts with hysteresis, and the exposures that they leave and take."""
    return S.judged(table(spark, sf, "events"))


@query("limited_events", "", f"""
    WITH RECURSIVE o AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
    g AS (SELECT user_id, r, ts FROM o WHERE r = 1 UNION ALL SELECT g.user_id, n.r, n.ts FROM g, LATERAL (SELECT * FROM o WHERE o.user_id = g.user_id AND o.r > g.r AND o.ts >= g.ts + INTERVAL {SECONDS} SECOND ORDER BY o.r LIMIT 1) n),
    j AS (SELECT e.user_id, e.event_id, e.ts, g.ts AS window_start FROM events e ASOF JOIN g ON e.user_id = g.user_id AND e.ts >= g.ts),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id, window_start ORDER BY ts, event_id) AS attempt FROM j)
    SELECT user_id, event_id, ts, window_start, CAST(attempt AS BIGINT) AS attempt, attempt <= {LIMIT} AS allowed FROM k""")
def limited_events(spark, sf):
    """Each user's attempts: three in six hours from the first one on."""
    return S.limited(table(spark, sf, "events"), limit=LIMIT, seconds=SECONDS)
