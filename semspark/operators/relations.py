"""Joins that keep the grain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semspark.operators.snapshot import valid_at


def pre_aggregated_left(fact: DataFrame, finer: DataFrame, keys: list[str], sums: Mapping[str, Column]) -> DataFrame:
    """fact with sums over a finer-grained relation, which is aggregated to the keys before it is joined: no row of fact is
    multiplied, and one without finer rows gets 0."""
    agg = finer.groupBy(*keys).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    out = fact.join(agg, keys, "left")
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in sums})


def shared_attribute(df: DataFrame, id_col: str, attribute: str, other: str = "related") -> DataFrame:
    """The symmetric relation of rows with equal, non-null attributes: (id, related id), never with itself.

    It is as large as the squares of the groups, by definition; aggregate or filter one side before materialising it.
    """
    rows = df.filter(F.col(attribute).isNotNull()).select(id_col, attribute)
    right = rows.select(F.col(id_col).alias(other), attribute)
    return rows.join(right, attribute).filter(F.col(id_col) != F.col(other)).select(id_col, other)


def has_member(fact: DataFrame, bridge: DataFrame, key: str, member_col: str, member: object) -> DataFrame:
    """Rows that have the member in a bridge (EXISTS); none is multiplied."""
    return fact.join(bridge.filter(F.col(member_col) == F.lit(member)).select(key), key, "left_semi")


def allocate(fact: DataFrame, bridge: DataFrame, key: str, measure: str) -> DataFrame:
    """fact by its distinct bridge members, the measure split evenly, so that it still sums to itself.

    The bridge is gathered by key once, as a set of members (the bridge's other columns), and its size is the divisor; a
    key's members are bounded by what one fact row relates to. Facts without a member are left out.
    """
    members = [c for c in bridge.columns if c != key]
    sets = bridge.groupBy(key).agg(F.collect_set(F.struct(*members)).alias("_members"))
    out = fact.join(sets, key).withColumn(measure, F.col(measure) / F.size("_members"))
    return out.select(*fact.columns, F.explode("_members").alias("_member")).select(*fact.columns, *(F.col("_member")[c].alias(c) for c in members))


def discriminated_union(rows: DataFrame, type_col: str, id_col: str, targets: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """A polymorphic reference resolved type by type: rows with `label`, taken from the target (frame, key, label column)
    that the type names; types without a target are left out."""
    out = None
    for kind, (frame, key, label) in targets.items():
        t = frame.select(F.col(key).alias("_key"), F.col(label).alias("label"))
        part = rows.filter(F.col(type_col) == F.lit(kind)).join(t, F.col(id_col) == F.col("_key")).drop("_key")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no targets")
    return out


def ratio_of_sums(df: DataFrame, keys: Sequence[str], numerator: str, denominator: str, out: str) -> DataFrame:
    """A weighted mean from a summary: sum over sum, never the mean of ratios."""
    return df.groupBy(*keys).agg((F.sum(numerator) / F.sum(denominator)).alias(out))


def per_fact_as_of(fact: DataFrame, versions: DataFrame, keys: list[str], at: str, valid_from: str, valid_to: str, how: str = "left") -> DataFrame:
    """Every fact row with the version of its key that held at the row's own time: an equi join on the key, the interval
    as a further condition."""
    v = versions.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in versions.columns if c not in keys))
    on = valid_at(valid_from, valid_to, F.col(at))
    for k in keys:
        on = on & (fact[k] == F.col(f"_{k}"))
    return fact.join(v, on, how).drop(*(f"_{k}" for k in keys))


def value_mapped_join(fact: DataFrame, key: str, mapping: DataFrame, source: str, target: str, dimension: DataFrame, dimension_key: str, how: str = "left") -> DataFrame:
    """A join whose keys are spelled differently on the two sides: through a mapping of source values to target keys. A
    source value that maps to several keys would multiply rows, so such values count as unmapped."""
    one = mapping.groupBy(F.col(source).alias("_source")).agg(F.min(target).alias("_target"), F.countDistinct(target).alias("_n")).filter("_n = 1").drop("_n")
    right = dimension.join(one, F.col(dimension_key) == F.col("_target"))
    return fact.join(right, F.col(key) == F.col("_source"), how).drop("_source", "_target")


def federated(left: DataFrame, left_key: str, alias: DataFrame, right: DataFrame, right_key: str) -> DataFrame:
    """Rows of two sources that an alias table (left_id, right_id) says are the same; sources are never joined on raw keys."""
    a = alias.select(F.col("left_id").alias("_l"), F.col("right_id").alias("_r")).distinct()
    return left.join(a, F.col(left_key) == F.col("_l")).join(right, F.col(right_key) == F.col("_r")).drop("_l", "_r")


def by_role(roles: Mapping[str, tuple[DataFrame, Column]], axis: str) -> DataFrame:
    """One dimension in several roles: rows counted along it, (role, axis, n), for each role's rows and its own expression. A
    role is named in every row; roles are never added up."""
    parts = [df.groupBy(F.lit(role).alias("role"), at.alias(axis)).agg(F.count(F.lit(1)).alias("n")) for role, (df, at) in roles.items()]
    return reduce(DataFrame.unionByName, parts)


def flag_counts(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Rows by each of some low-cardinality flags on its own, in one pass: the other flags are null in a row."""
    return df.groupingSets([[F.col(f)] for f in flags], *flags).agg(F.count(F.lit(1)).alias("n"))
