"""Latest dates within a scope, and values read at them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equal_all(scope: dict[str, object] | None) -> Column:
    """Equality on every entry; a null value asks for null."""
    out = F.lit(True)
    for k, v in (scope or {}).items():
        out = out & (F.col(k).isNull() if v is None else F.col(k) == F.lit(v))
    return out


def scoped_latest(df: DataFrame, date_column: str, scope: dict[str, object] | None = None) -> DataFrame:
    """One row `latest`: the greatest date among rows in scope (all rows, if there is none); null if no row is."""
    rows = df.filter(equal_all(scope)) if scope else df
    return rows.agg(F.max(date_column).alias("latest"))


def at_latest(df: DataFrame, date_column: str, scope: dict[str, object] | None = None) -> DataFrame:
    """The rows in scope that carry its latest date. The date is a one-row scalar subquery, so the rows aren't shuffled."""
    rows = df.filter(equal_all(scope)) if scope else df
    return rows.filter(F.col(date_column) == scoped_latest(df, date_column, scope).scalar())


def value_at_latest(df: DataFrame, cell: list[str], date_column: str, value: str, tie: str | None = None) -> DataFrame:
    """A stock's value for each cell, at the cell's own latest date; equal dates go to the greatest tie-breaker."""
    order = F.struct(date_column, tie) if tie else F.col(date_column)
    return df.groupBy(*cell).agg(F.max_by(value, order).alias(value))
