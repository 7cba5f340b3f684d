"""Register tables: closed sets and groupings that live in data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spellings that a register's flag column may use for true.
TRUE_WORDS = ("true", "1", "yes", "t")
SENTINEL = "^__.*__$"


def enum_from_register(register: DataFrame, key_column: str = "code") -> DataFrame:
    """The closed set: a register's distinct keys, nulls, blanks and sentinels (__x__) left out."""
    return distinct_values(register, key_column)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.select(column).filter(c.isNotNull() & (F.trim(c.cast("string")) != "") & ~c.cast("string").rlike(SENTINEL)).distinct()


def truthy(column: str):
    return F.coalesce(F.lower(F.trim(F.col(column).cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def grouping_from_register(register: DataFrame, group_key: str | Sequence[str], member_col: str | None = None, carry: Sequence[str] = (), *, member: str | None = None) -> DataFrame:
    """One row for each group of an exploded register (a row for each member): the key, `members` sorted and each once,
    and the carried columns (of several values in a group, the least). `member` is another name for member_col."""
    col = member_col or member
    if col is None:
        raise ValueError("member_col is needed")
    keys = [group_key] if isinstance(group_key, str) else list(group_key)
    return register.groupBy(*keys).agg(F.array_sort(F.collect_set(col)).alias("members"), *(F.min(c).alias(c) for c in carry))


def composite_groupings(register: DataFrame, scheme: str, namespace: str, code: str, member: str) -> DataFrame:
    """One row for each definition (scheme, namespace, code): member_count, and collides_with, the other definitions that
    share the bare code."""
    defs = register.groupBy(scheme, namespace, code).agg(F.countDistinct(member).alias("member_count"))
    ident = F.concat_ws(":", scheme, namespace, code)
    peers = defs.groupBy(code).agg(F.collect_set(ident).alias("_all"))
    out = defs.withColumn("_ident", ident).join(peers, code)
    return out.select(scheme, namespace, code, "member_count", F.array_sort(F.array_except("_all", F.array("_ident"))).alias("collides_with"))


def served_groups(register: DataFrame, group_key: str, flag: str) -> DataFrame:
    """One row: groups in all, and groups with a row whose flag is true."""
    return register.agg(F.countDistinct(group_key).alias("groups"), F.countDistinct(F.when(truthy(flag), F.col(group_key))).alias("served"))
