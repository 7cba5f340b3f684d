"""Predicates that the model adds: exclusions and defaults."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exclusion_filter(df: DataFrame, column: str, not_in: Sequence[object] = (), not_like: Sequence[str] = ()) -> DataFrame:
    """Rows whose value is neither listed nor like a pattern. As in SQL, a null value passes no such test, so its row goes
    too, unless nothing is excluded."""
    keep = F.lit(True)
    if not_in:
        keep = keep & ~F.col(column).isin(list(not_in))
    for p in not_like:
        keep = keep & ~F.col(column).like(p)
    return df.filter(keep) if not_in or not_like else df


def attribute_filter(df: DataFrame, equal: Mapping[str, object] | None = None, between: Mapping[str, tuple[object, object]] | None = None) -> DataFrame:
    """Rows whose curated attributes have the values given, or lie between two (both included); null passes no test."""
    for column, value in (equal or {}).items():
        df = df.filter(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == F.lit(value))
    for column, (low, high) in (between or {}).items():
        df = df.filter(F.col(column).between(low, high))
    return df


@dataclass(frozen=True)
class Defaulted:
    df: DataFrame
    applied: bool
    disclosure: str


def axis_default(df: DataFrame, axis_column: str, default: object, bound: Sequence[str] = ()) -> Defaulted:
    """Pin an axis to its default, unless the question binds it: by a filter or by grouping."""
    if axis_column in bound:
        return Defaulted(df, False, "")
    return Defaulted(df.filter(F.col(axis_column) == F.lit(default)), True, f"{axis_column} was not given; {default!r} is assumed")
