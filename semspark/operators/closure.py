"""Closed value sets: values outside them are anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closure_anomaly_check(df: DataFrame, column: str, closure: str, known: Sequence[object] | DataFrame) -> DataFrame | None:
    """Distinct values outside a closed set; None for an open or unknown one, which has no anomaly to find.

    An empty closed set makes every value an anomaly. Nulls aren't values: see null_report. `known` may be a one-column
    DataFrame (a register); then the sets are compared by an anti join instead of a list.
    """
    if closure not in ("closed", "open", "unknown"):
        raise ValueError(f"unknown closure: {closure}")
    if closure != "closed":
        return None
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    if isinstance(known, DataFrame):
        return values.join(known.select(F.col(known.columns[0]).alias(column)), column, "left_anti")
    return values.filter(~F.col(column).isin(list(known))) if len(known) else values


def null_report(df: DataFrame, column: str) -> DataFrame:
    """One row: how many values are null, of how many."""
    return df.agg(F.count(F.when(F.col(column).isNull(), 1)).alias("nulls"), F.count(F.lit(1)).alias("rows"))
