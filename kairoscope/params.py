"""Fixed parameters of the model, in one place, with a digest over them."""

from __future__ import annotations

import hashlib
import json

# Series registry (unit, frequency, calendar days, business days, release lag, required, fallback).
SERIES = {
    "WALCL": ("M", "WEEKLY", 10, 7, 1, True, "FORWARD_FILL"),
    "WTREGEN": ("M", "WEEKLY", 10, 7, 1, False, "FORWARD_FILL"),
    "WDTGAL": ("M", "WEEKLY", 10, 7, 1, True, "FORWARD_FILL"),
    "WRBWFRBL": ("M", "WEEKLY", 10, 7, 1, True, "FORWARD_FILL"),
    "RRPONTSYD": ("B", "DAILY", 4, 2, 0, True, "FORWARD_FILL"),
    "RPONTSYD": ("B", "DAILY", 4, 2, 0, False, "FORWARD_FILL"),
    "SOFR": ("P", "DAILY", 4, 2, 1, True, "FORWARD_FILL"),
    "IORB": ("P", "DAILY", 4, 2, 0, True, "FORWARD_FILL"),
    "BAMLH0A0HYM2": ("P", "DAILY", 4, 2, 1, True, "FORWARD_FILL"),
    "DGS10": ("P", "DAILY", 4, 2, 1, True, "FORWARD_FILL"),
    "VIXCLS": ("I", "DAILY", 4, 2, 1, False, "NONE"),
    "DTWEXBGS": ("I", "DAILY", 10, 7, 7, True, "FORWARD_FILL"),
    "SP500": ("I", "DAILY", 4, 2, 1, False, "NONE"),
    "T10Y2Y": ("P", "DAILY", 4, 2, 1, True, "FORWARD_FILL"),
    "ECBASSETSW": ("I", "WEEKLY", 14, 10, 4, False, "FORWARD_FILL"),
    "JPNASSETS": ("I", "MONTHLY", 45, 32, 10, False, "FORWARD_FILL"),
    "DEXUSEU": ("I", "DAILY", 4, 2, 1, False, "FORWARD_FILL"),
    "DEXJPUS": ("I", "DAILY", 4, 2, 1, False, "FORWARD_FILL"),
}

# Scores and decisions.
WEIGHTS = {
    "trend": 0.35, "impulse": 0.05, "credit": 0.06, "funding": 0.04, "rates": 0.05,
    "dollar": 0.18, "vol": 0.0, "reserve": 0.12, "curve": 0.15,
}
BULL_ABOVE, BEAR_BELOW, NEUTRAL = 55.0, 45.0, 50.0
TREND_WEEKS, DIRECTION_GAP = 13, 0.002
IMPULSE_STEP, IMPULSE_WEEKS = 50.0, 13
CADENCE = {"DAILY": (1, 4), "WEEKLY": (5, 10), "MONTHLY": (20, 45)}
POLICY_SWITCH = "2025-12-01"
STRESS_CEILING = 65.0
VIX_STRESS = 28.0
EXPOSURES = {"full": 1.0, "high": 0.9, "low": 0.25, "cautious": 0.5, "middle": 0.75}
ARM_DISTANCE = 2.0

# Event time.
ELIGIBLE_AT, ACCOUNTED_AT = "17:00:00", "23:59:59"
CASH_STALE_DAYS, VIX_STALE_DAYS = 4, 4
COMMISSION_BPS, SLIPPAGE_BPS, STRESS_SLIPPAGE_BPS, FINANCING_BPS = 1.0, 2.0, 3.0, 100.0
SESSIONS, VOL_TARGET, VOL_SESSIONS, MA_SESSIONS = 252, 0.10, 20, 200

# Validation and diagnostics.
HORIZON_WEEKS, EMBARGO_DAYS, TRAIN_PAIRS, TEST_PAIRS, TOLERANCE_DAYS = 13, 91, 200, 52, 14
MIN_RATE, MIN_IC, MIN_TAIL, MIN_TAIL_EVENTS = 5, 3, 20, 3
BUCKETS = (0, 20, 35, 45, 55, 65, 80, 100)
BH_ALPHA = 0.05
BOOTSTRAP = {"iterations": 2000, "block": 13, "seed": 12345}
MAD_WEEKS, MAD_MIN = 156, 52
CHALLENGER = {"gap": 0.45, "impulse4": 0.35, "impulse13": 0.20}
RESERVE = {"relative": 0.30, "change": 0.25, "funding": 0.25, "auxiliary": 0.20}
TGA_MULTIPLIERS = (1.0, 0.6, 0.25)


def canonical_json(value: object) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest() -> str:
    """SHA-256 over all parameters, so that none can drift unseen."""
    held = {k: v for k, v in globals().items() if k.isupper()}
    return hashlib.sha256(canonical_json(held).encode()).hexdigest()
