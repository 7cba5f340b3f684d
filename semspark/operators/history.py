"""Attributes that keep a bounded history in columns: the current value and so many before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semspark.plans.intent import NotDerivable


def value_before(df: DataFrame, attribute: str, kept: Sequence[str], changes: int, out: str = "value") -> DataFrame | NotDerivable:
    """df with the attribute's value so many changes ago: kept[0] is the current one, kept[1] the one before, and so on.

    Beyond the kept depth there is no answer: what was overwritten can't be told, and the oldest kept value isn't it.
    """
    if changes < 0:
        raise ValueError("changes must be 0 or more")
    if changes >= len(kept):
        return NotDerivable(attribute, attribute, tuple(kept), f"{attribute} keeps {len(kept) - 1} earlier values; {changes} changes ago is beyond")
    return df.withColumn(out, F.col(kept[changes]))
