"""CSV registers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def read_register(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A register with a header as strings, its columns as named; a file that isn't there is an empty register, and a
    column that it lacks is null."""
    empty = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    try:
        found = spark.read.option("header", True).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return empty
        raise
    return empty.unionByName(found.select(*(c for c in columns if c in found.columns)), allowMissingColumns=True)
