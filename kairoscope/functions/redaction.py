"""Redaction of nested log fields, a bounded walk over one JSON value for each row."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import BEARER, SECRET

# Keys whose values are masked, and how much of a value is shown.
SECRET_KEY = re.compile(r"authorization|token|secret|api.?key|password", re.IGNORECASE)
MASKED, CUT = "[REDACTED]", "[TRUNCATED]"
MOST_TEXT, MOST_DEPTH, MOST_ITEMS, MOST_KEYS = 512, 4, 32, 64

_TEXT = [(re.compile(SECRET.removeprefix("(?i)"), re.IGNORECASE), r"\1" + MASKED), (re.compile(BEARER.removeprefix("(?i)"), re.IGNORECASE), "Bearer " + MASKED)]


def text(value: str) -> str:
    for pattern, shown in _TEXT:
        value = pattern.sub(shown, value)
    return value[:MOST_TEXT]


def field(key: str, value: object, depth: int = 0) -> object:
    """What a log may show of a field: no secrets, and bounded text, depth, items and keys."""
    if SECRET_KEY.search(key):
        return MASKED
    if isinstance(value, str):
        return text(value)
    if value is None or isinstance(value, bool | int | float):
        return value
    if depth >= MOST_DEPTH:
        return CUT
    if isinstance(value, list):
        return [field("", x, depth + 1) for x in value[:MOST_ITEMS]]
    return {k: field(k, x, depth + 1) for k, x in list(value.items())[:MOST_KEYS]}


def redact_json(column: Column | str) -> Column:
    """JSON text with its fields redacted; text that is no JSON is redacted as text, null stays null."""

    def one(value: str | None) -> str | None:
        if value is None:
            return None
        try:
            held = json.loads(value)
        except ValueError:
            return text(value)
        return json.dumps(field("", held), ensure_ascii=False, separators=(",", ":"))

    @F.pandas_udf("string")
    def redacted(values: pd.Series) -> pd.Series:
        return values.map(one, na_action="ignore")

    return redacted(column)
