"""Versioned relations: latest version, version at an instant, and bitemporal reads."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_collapse(df: DataFrame, natural_key: list[str], order_by: str, tie: list[str]) -> DataFrame:
    """One row for each key: the greatest by order_by, then by the tie-breakers. Without any, ties would be arbitrary, so
    at least one is asked for. A key column that is null is a key of its own."""
    if not tie:
        raise ValueError("a tie-breaker is needed for a result that doesn't change from run to run")
    w = Window.partitionBy(*natural_key).orderBy(F.col(order_by).desc_nulls_last(), *(F.col(t).desc_nulls_last() for t in tie))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def valid_at(valid_from: str, valid_to: str, at: Column) -> Column:
    """Half-open: from <= at < to; a null end is open."""
    return (F.col(valid_from) <= at) & (F.col(valid_to).isNull() | (F.col(valid_to) > at))


def as_of(df: DataFrame, valid_from: str, valid_to: str, at: date | datetime | Column) -> DataFrame:
    return df.filter(valid_at(valid_from, valid_to, at if isinstance(at, Column) else F.lit(at)))


def bitemporal_as_of(df: DataFrame, valid: tuple[str, str], recorded: tuple[str, str], valid_time: date | datetime, known_time: date | datetime) -> DataFrame:
    """What held at valid_time, as it was known at known_time."""
    return as_of(as_of(df, *valid, valid_time), *recorded, known_time)


def overlapping(df: DataFrame, natural_key: list[str], valid_from: str, valid_to: str) -> DataFrame:
    """Keys with versions that overlap, so that an instant has two: what as_of takes for granted, to be checked."""
    w = Window.partitionBy(*natural_key).orderBy(valid_from, F.col(valid_to).asc_nulls_last())
    after = F.lead(valid_from).over(w)
    clash = after.isNotNull() & (F.col(valid_to).isNull() | (after < F.col(valid_to)))
    return df.withColumn("_clash", clash).filter("_clash").select(*natural_key).distinct()
