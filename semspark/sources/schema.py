"""Descriptor columns as Spark types."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from semspark.model.types import Model, Table

_PLAIN = {
    "string": T.StringType, "integer": T.IntegerType, "int": T.IntegerType, "bigint": T.LongType, "boolean": T.BooleanType, "date": T.DateType, "timestamp": T.TimestampType, "datetime": T.TimestampType,
    "number": T.DoubleType, "float": T.DoubleType, "double": T.DoubleType,
}


def spark_type(name: str | None) -> T.DataType:
    """string, integer, bigint, decimal(p,s), numeric, number, date, timestamp, array<...>; what isn't known is a string."""
    n = (name or "string").strip().lower()
    if m := re.fullmatch(r"(?:decimal|numeric)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?", n):
        return T.DecimalType(int(m[1] or 38), int(m[2] or (0 if m[1] else 10)))
    if m := re.fullmatch(r"array\s*<(.+)>", n):
        return T.ArrayType(spark_type(m[1]))
    return _PLAIN.get(n, T.StringType)()


def struct_type(table: Table) -> T.StructType:
    return T.StructType([T.StructField(c["name"], spark_type(c.get("type")), c.get("nullable", c["role"] != "primary_key")) for c in table.columns])


def _family(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(t, (T.DecimalType, T.DoubleType, T.FloatType)):
        return "number"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    return t.simpleString()


def drift(df: DataFrame, table: Table) -> list[str]:
    """Columns missing, surplus, or of another family of types; widenings (int to bigint, decimal to double) are none."""
    have, want = {f.name: f.dataType for f in df.schema.fields}, {f.name: f.dataType for f in struct_type(table).fields}
    out = [f"{table.name}.{c} is missing" for c in want if c not in have] + [f"{table.name}.{c} isn't described" for c in have if c not in want]
    return out + [f"{table.name}.{c} is {have[c].simpleString()}, described as {want[c].simpleString()}" for c in want if c in have and _family(have[c]) != _family(want[c])]


def bind(model: Model, frames: Mapping[str, DataFrame], views: bool = False) -> list[str]:
    """Frames checked against their descriptors, and registered as temporary views if asked."""
    out = []
    for name, df in frames.items():
        if name in model.tables:
            out += drift(df, model.tables[name])
        if views:
            df.createOrReplaceTempView(name)
    return out
