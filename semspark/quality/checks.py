"""Keys, foreign keys, cardinalities, assertions, schemas. Each returns a DataFrame of offenders or of counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semspark.model.types import Model, Table, Transform
from semspark.plans.guards import lineage
from semspark.sources.schema import drift


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that several rows have, and how many."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: nulls in each column."""
    return df.agg(*(F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns))


def foreign_key_orphans(df: DataFrame, columns: Sequence[str], target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct foreign keys that no target row has; keys with a null are none."""
    mine = df.select(*columns).dropna().distinct()
    return mine.join(target.select(*(F.col(k).alias(f"_{k}") for k in keys)), reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_{k}") for c, k in zip(columns, keys, strict=True))), "left_anti")


def cardinality(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: the most rows that a key has, and keys in all. An edge into it is many-to-one if the most is 1."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("keys"))


def assertion(df: DataFrame, sql: str) -> DataFrame:
    """Rows for which a condition is false or unknown."""
    return df.filter(~F.coalesce(F.expr(sql), F.lit(False)))


def constraints(model: Model, concept: str, df: DataFrame) -> list[tuple[str, str, int]]:
    """(assertion, severity, rows against it) for a concept's executable constraints, counted in one pass."""
    c = [x for x in model.concepts[concept].doc.get("constraints") or [] if x.get("sql_assertion")]
    if not c:
        return []
    row = df.agg(*(F.count(F.when(~F.coalesce(F.expr(x["sql_assertion"]), F.lit(False)), 1)) for x in c)).first()
    return [(x["assert"], x.get("severity", "ERROR"), n) for x, n in zip(c, row, strict=True)]  # type: ignore[arg-type]


def guarantees(model: Model, frames: Mapping[str, DataFrame]) -> DataFrame:
    """What the model's rules of kind guarantee promise, checked: (rule_id, relation, offenders). A promise is checked by the
    rule's x-assert, a condition on its concept's rows; one in prose only isn't listed. A relation is read once for all."""
    parts = []
    for c in model.concepts.values():
        said = [r for r in c.rules if str(r.get("kind", "")).endswith("guarantee") and r.get("x-assert")]
        if not said or c.relation not in frames:
            continue
        row = frames[c.relation].agg(F.array(*(F.struct(F.lit(r["id"]).alias("rule_id"), F.count(F.when(~F.coalesce(F.expr(r["x-assert"]), F.lit(False)), 1)).alias("offenders")) for r in said)).alias("r"))
        parts.append(row.select(F.explode("r").alias("r")).select("r.rule_id", F.lit(c.relation).alias("relation"), "r.offenders"))
    if not parts:
        return next(iter(frames.values())).sparkSession.createDataFrame([], "rule_id string, relation string, offenders bigint")
    return reduce(DataFrame.unionByName, parts)


def reconcile(a: DataFrame, b: DataFrame, value: str, tolerance: float = 0.0) -> DataFrame:
    """Two one-row figures side by side: a, b, gap, share of b, and if they agree."""
    x, y = a.select(F.col(value).alias("a")), b.select(F.col(value).alias("b"))
    gap = F.col("a") - F.col("b")
    return x.crossJoin(y).select("a", "b", gap.alias("gap"), (gap / F.col("b")).alias("share"), (F.abs(gap) <= tolerance).alias("agrees"))


def produced_schema(df: DataFrame, table: Table) -> list[str]:
    """Differences between what a transform yields and what its descriptor says."""
    return drift(df, table)


def lineage_gaps(spark: SparkSession, transform: Transform) -> list[str]:
    """Relations that a transform's SQL reads but doesn't declare, and the other way round; views must exist."""
    read = lineage(spark.sql(transform.sql or "SELECT 1"))
    said = {i["relation"].split(".")[-1] for i in transform.inputs}
    named = {r for r in read if spark.catalog.tableExists(r)}
    return [f"reads {r}, which isn't declared" for r in sorted(named - said)] + [f"declares {r}, which isn't read" for r in sorted(said - named)]


def report(model: Model, frames: Mapping[str, DataFrame]) -> DataFrame:
    """Every key and foreign key of the descriptors, checked over the frames: (kind, relation, columns, offenders)."""
    spark = next(iter(frames.values())).sparkSession
    parts = []

    def counted(df: DataFrame, kind: str, relation: str, columns: Sequence[str]) -> None:
        said: list[Column] = [F.lit(kind).alias("kind"), F.lit(relation).alias("relation"), F.lit(",".join(columns)).alias("columns")]
        parts.append(df.agg(F.count(F.lit(1)).alias("offenders")).select(*said, "offenders"))

    for t in model.tables.values():
        if t.name not in frames:
            continue
        if t.key:
            counted(duplicate_keys(frames[t.name], t.key), "unique", t.name, t.key)
        for fk in t.foreign_keys:
            if fk["to_table"] in frames:
                counted(foreign_key_orphans(frames[t.name], [fk["from_column"]], frames[fk["to_table"]], [fk["to_column"]]), "foreign_key", t.name, [fk["from_column"]])
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "kind string, relation string, columns string, offenders bigint")
