"""Where tables about the model go: JSON lines, and statements for a warehouse that reads them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from semspark.model.types import Table


def write_ndjson(tables: Mapping[str, DataFrame], folder: str) -> None:
    """A folder of JSON lines for each table; nulls are written, so that every line has every column."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/{name}")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def external_table_ddl(name: str, df: DataFrame, folder: str) -> str:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return f"CREATE TABLE {name} ({columns}) USING JSON LOCATION {_quoted(f'{folder}/{name}')}"


def view_ddl(table: Table, select: str) -> str:
    return f"CREATE OR REPLACE TEMPORARY VIEW {table.name} AS {select.strip().rstrip(';')}"
