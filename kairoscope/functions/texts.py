"""Texts that a decision shows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of a decision's reason.
IMPULSE_LABEL = {"EXPANDING": "扩表", "CONTRACTING": "缩表", "FLAT": "横住"}
DIRECTION_LABEL = {"UP": "在升", "DOWN": "在收", "FLAT": "走平"}
VERDICT_LABEL = {"BULLISH": "偏多", "BEARISH": "偏空", "NEUTRAL": "中性"}
EASING_GAP, TIGHTENING_GAP = "(缩表却放水,留意背离)", "(扩表却收水,留意背离)"
INCOMPLETE = "宏观数据不完整，暂停方向性判断"


def label(column: str, labels: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[F.col(column)]


def reason(impulse: str, direction: str, verdict: str) -> Column:
    """Why a verdict stands, with a hint where the balance sheet and net liquidity part; null without a verdict."""
    i, d = F.col(impulse), F.col(direction)
    gap = F.when((i == "CONTRACTING") & (d == "UP"), EASING_GAP).when((i == "EXPANDING") & (d == "DOWN"), TIGHTENING_GAP).otherwise("")
    return F.concat(F.lit("Fed "), label(impulse, IMPULSE_LABEL), F.lit("、净流动性"), label(direction, DIRECTION_LABEL), F.lit(" → 环境"), label(verdict, VERDICT_LABEL), gap)
