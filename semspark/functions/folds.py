"""How measures combine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEGAL = {"additive": ("sum", "avg", "min", "max", "median", "count"), "point_in_time": ("avg", "min", "max", "median"), "averageable": ("avg", "median", "percentile", "min", "max"), "non_aggregable": ()}


def legal_folds(effect: str) -> tuple[str, ...]:
    return LEGAL[effect]


def fold(name: str, value: Column, share: float = 0.5) -> Column:
    """An aggregate; medians and percentiles are exact."""
    if name == "percentile":
        return F.percentile(value, F.lit(share))
    if name == "median":
        return F.percentile(value, F.lit(0.5))
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[name](value)
