"""Absent rows: fill a grid with zeros where the absence of a row means zero."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cross_grid(*axes: DataFrame) -> DataFrame:
    """Every combination of the axes' rows. Axes are member lists, small beside a fact; a Cartesian product of them is the
    grid's definition, so its size is the product of theirs."""
    out = axes[0]
    for a in axes[1:]:
        out = out.crossJoin(a)
    return out


def densify(fact: DataFrame, measure: str, keys: list[str], grid: DataFrame, fill: object = 0) -> DataFrame:
    """One row for each grid row: its keys, and the measure, or `fill` where the fact has no row or a null.

    A fact with several rows for a key yields several rows; aggregate first for one. Other columns don't survive. A null
    key in the grid matches no fact row and is filled.
    """
    g = grid.select(*keys)
    return g.join(fact.select(*keys, measure), keys, "left").select(*keys, F.coalesce(F.col(measure), F.lit(fill)).alias(measure))


def absence_average(fact: DataFrame, measure: str, keys: list[str], grid: DataFrame, meaning: str, loaded: Column | None = None) -> DataFrame:
    """The average of a measure under what its absence means, as one row (average, cells, present).

    genuine_zero: absent cells count as 0. not_loaded: cells for which `loaded` isn't true leave the average; they are
    the difference of cells and present. structurally_untracked: only cells with a row count.
    """
    cells = grid.select(*keys).join(fact.select(*keys, measure), keys, "left")
    present = F.count(measure)
    if meaning == "genuine_zero":
        return cells.agg(F.avg(F.coalesce(F.col(measure), F.lit(0))).alias("average"), F.count(F.lit(1)).alias("cells"), present.alias("present"))
    if meaning == "not_loaded":
        ok = loaded if loaded is not None else F.col(measure).isNotNull()
        return cells.agg(F.avg(F.when(ok, F.coalesce(F.col(measure), F.lit(0)))).alias("average"), F.count(F.lit(1)).alias("cells"), F.count(F.when(ok, 1)).alias("present"))
    if meaning == "structurally_untracked":
        return cells.agg(F.avg(measure).alias("average"), F.count(F.lit(1)).alias("cells"), present.alias("present"))
    raise ValueError(f"unknown meaning of absence: {meaning}")


def absence_average_over(fact: DataFrame, measure: str, axes: Mapping[str, DataFrame]) -> DataFrame:
    """absence_average with genuine zeros over the grid of whole axes (fact column -> its members), and the average of present
    cells beside it, as one row (average, average_present, cells, present). No grid is made: absent cells only add to the
    divisor, which is the product of the axes' sizes. The fact has one row at most for a cell; rows off the axes don't count.
    """
    sizes = []
    for column, members in axes.items():
        keys = members.select(F.col(members.columns[0]).alias(column)).distinct()
        fact = fact.join(keys, column, "left_semi")
        sizes.append(keys.agg(F.count(F.lit(1)).alias("n")))
    cells = F.lit(1).cast("bigint")
    for size in sizes:
        cells = cells * size.scalar()
    total = fact.agg(F.coalesce(F.sum(measure), F.lit(0)).alias("total"), F.count(measure).alias("present"), F.avg(measure).alias("average_present"))
    return total.select((F.col("total") / F.nullif(cells, F.lit(0))).alias("average"), "average_present", cells.alias("cells"), "present")
