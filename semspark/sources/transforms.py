"""Pipelines of the data plane: typed inputs, and views over them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from semspark.model.types import Model, Transform
from semspark.model.vocab import INPUT_KINDS
from semspark.sources.registers import read_register
from semspark.sources.schema import struct_type


def read_input(spark: SparkSession, model: Model, spec: Mapping, frames: Mapping[str, DataFrame], folder: str | None = None) -> DataFrame:
    """A declared input as a DataFrame: a given frame, else a session table, else (an authored seed) its CSV."""
    kind, name = spec.get("kind", "dataset"), spec["relation"].split(".")[-1]
    if kind not in INPUT_KINDS:
        raise ValueError(f"unknown input kind: {kind}")
    if name in frames:
        return frames[name]
    if kind == "external":
        raise KeyError(f"external input {name} must be given")
    if kind == "authored_seed":
        described = model.tables.get(name) or model.sources.get(name)
        columns = [f.name for f in struct_type(described).fields] if described else []
        return read_register(spark, f"{folder}/{name}.csv", columns)
    return spark.table(name)


def build_view(spark: SparkSession, model: Model, transform: Transform, frames: Mapping[str, DataFrame]) -> DataFrame:
    """The transform's query over its inputs, registered under the relation's bare name."""
    if not transform.sql:
        raise ValueError(f"{transform.relation} has no query")
    for spec in transform.inputs:
        read_input(spark, model, spec, frames).createOrReplaceTempView(spec["relation"].split(".")[-1])
    out = spark.sql(transform.sql)
    out.createOrReplaceTempView(transform.relation.split(".")[-1])
    return out
