"""Cleansing steps of the data plane."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def basis_points_to_fraction(c: Column) -> Column:
    """700 -> 0.0700. Fourteen digits hold every integer, so that no number of basis points overflows before the division."""
    return (c.cast("decimal(14,4)") / 10000).cast("decimal(14,4)")


def cents_to_amount(c: Column) -> Column:
    return (c.cast("decimal(14,2)") / 100).cast("decimal(12,2)")


def canonical_status(c: Column, spellings: Mapping[str, str], unknown: str | None = None) -> Column:
    """Trimmed, lower-cased spellings to codes of the enumeration; others become `unknown` where it is given, else null."""
    key = F.lower(F.trim(c))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for spelling, code in spellings.items():
        out = out.when(key == spelling.lower(), code)
    return out.otherwise(F.lit(unknown).cast("string"))


def lifecycle_state(milestones: Sequence[tuple[str, str]], start: str) -> Column:
    """The furthest state reached: milestones (column, state) in order; a state counts once its column isn't null."""
    out = F.when(F.lit(False), F.lit(start))
    for column, state in reversed(list(milestones)):
        out = out.when(F.col(column).isNotNull(), state)
    return out.otherwise(start)


def milestone_lag(start: str, end: str) -> Column:
    """Days from one milestone to another; null while either is open."""
    return F.datediff(F.col(end), F.col(start))
